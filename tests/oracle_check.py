"""Run registered queries and their SQL side by side: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def kind(t: str) -> str:
    return str(t).upper().split("(")[0]


def compare(name: str, spark, sf_dir: str, con, queries: dict, sql: dict) -> str:
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    took = time.time() - start
    if name not in sql:
        return f"rows={len(got)} (no SQL) {took:.1f}s"
    res = con.execute(sql[name])
    cols = [d[0] for d in res.description]
    types = dict(zip(cols, [kind(d[1]) for d in res.description]))
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = [tuple(r[i] for i in order) for r in res.fetchall()]
    if sorted(cols) != sorted(df.columns):
        return f"BAD columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return f"BAD row count {len(got)} vs {len(want)}"
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a, b = sorted(got, key=key), sorted(want, key=key)
    for x, y in zip(a, b):
        if any(type(p) is not type(q) or p != q for p, q in zip(x, y)):
            return f"BAD row {x} vs {y} ({sum(p != q for p, q in zip(a, b))} differ)"
    note = ""
    for f in df.schema.fields:
        s = f.dataType.simpleString().upper()
        same = {"BIGINT": "BIGINT", "INT": "INTEGER", "DOUBLE": "DOUBLE", "STRING": "VARCHAR",
                "BOOLEAN": "BOOLEAN", "TINYINT": "TINYINT"}.get(s)
        d = types[f.name]
        if same and same not in d and d not in ("NUMBER", "STRING"):
            note += f" type {f.name}: {s} vs {d};"
    return f"ok rows={len(got)} {took:.1f}s{note}"


def main() -> int:
    import duckdb

    import __spark_entry__ as entry
    from alarmloom.runtime import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = local_session("oracle")
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for n in names:
        try:
            out = compare(n, spark, sf_dir, con, queries, sql)
        except Exception as e:  # noqa: BLE001
            out = f"BAD {type(e).__name__}: {str(e)[:600]}"
        bad += "BAD" in out
        print(f"{n:36s} {out}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
