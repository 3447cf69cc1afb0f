import re

import numpy as np
import xxhash

from alarmloom.llm import queries, simhash
from alarmloom.llm.common import GUESSED_LIMIT, share_join, tune

WORD = re.compile("[^\x20\x09-\x0d]+")
U64 = 2**64 - 1


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(prints, ids):
    """Least id reachable from every fingerprint, all pairs compared."""
    f = sorted(set(prints))
    a = np.array(f, np.uint64)
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= simhash.DISTANCE):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    least = {}
    for p, i in zip(prints, ids):
        r = find(f.index(p))
        least[r] = min(least.get(r, i), i)
    return [least[find(f.index(p))] for p in prints]


def test_query(spark, sf, documents):
    rows = sorted(queries.op2_simhash(spark, sf).collect(), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts)
    prints = [int(r["fingerprint"], 16) for r in rows]
    assert prints == [plain(texts[r["doc_id"]]) for r in rows]
    assert [r["component_id"] for r in rows] == classes(prints, [r["doc_id"] for r in rows])


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(1)
    prints = set()
    for centre in (0x123456789ABCDEF0, 0, U64):
        for _ in range(150):
            x = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = {p: p - 2**64 if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(signed[p],) for p in prints], "fp long")
    want = classes(prints, list(range(len(prints))))
    for paired in (simhash.PAIRED, 2, 10**6):
        links = [(r["a"] & U64, r["b"] & U64) for r in simhash.links(df, paired).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        index = {p: i for i, p in enumerate(prints)}
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(index[a]), find(index[b])
            parent[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(prints))] == want


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = [r["text"] for r in odd_docs.collect()]
    assert sorted(r["fp"] & U64 for r in rows) == sorted(map(plain, texts))
    empty = [r["component_id"] for r in rows if r["fp"] == 0]
    assert set(empty) == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert simhash.components(no_docs).count() == 0


def test_a_third_of_all_rows_in_one_key(spark, monkeypatch):
    """Lookups too big to broadcast give the same rows; those of the hot fingerprint stay spread over the tasks."""
    rows = [(i, "one and the same text" if i % 3 == 0 else f"text {i % 40} of {i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted(simhash.components(docs).collect())
    joined = []

    def unbroadcast(*args, **kw):
        joined.append(share_join(*args, **kw, limit=0))
        return joined[-1]

    monkeypatch.setattr(simhash, "share_join", unbroadcast)
    out = simhash.components(docs)
    assert sorted(out.collect()) == want
    hot = next(r["fp"] for r in want if r["doc_id"] == 0)
    parts = joined[-1].filter(f"fp = {hot}").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 200 and max(r["count"] for r in parts) <= 100


def test_what_an_explode_repeats_is_not_broadcast(spark, monkeypatch):
    """Spark sizes 64 variants of a fingerprint like one row; its default limit of 10 MB would send hundreds of MB through the driver."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    made = simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda df, label: made(plan(df), label))
    prints = spark.range(200).selectExpr("id AS fp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        assert plan(simhash.links(prints, 4)).count()
        assert len(plans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
        tune(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(GUESSED_LIMIT)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tune(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
