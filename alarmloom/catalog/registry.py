"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


# --- SQL of the adapter views -------------------------------------------------------------------

ALARMS = """alarms AS (SELECT CAST(vec_id AS BIGINT) AS index, CAST(embedding AS DOUBLE[]) AS features,
  CASE WHEN (label < 5) = (vec_id % 4 = 0) THEN 1 ELSE 0 END AS y_true, 1 AS y_pred,
  CAST(label AS BIGINT) AS given_cid FROM embeddings)"""

CELLS = ALARMS + """,
cells AS (SELECT index, y_true, given_cid, unnest(range(len(features))) AS dim,
  unnest(features) AS v FROM alarms)"""

NORMED = CELLS + """,
ends AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM cells GROUP BY dim),
normed AS (SELECT index, y_true, given_cid, dim, log2(1.0 + least(1.0, greatest(0.0,
  (v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END))) AS v FROM cells JOIN ends USING (dim))"""

SELECTED = NORMED + """,
picked AS (SELECT dim, row_number() OVER (ORDER BY var_pop(v) DESC, dim) - 1 AS pos
  FROM normed GROUP BY dim QUALIFY pos < 20),
vec AS (SELECT index, y_true, given_cid, list(v ORDER BY pos) AS f
  FROM normed JOIN picked USING (dim) GROUP BY index, y_true, given_cid)"""


def knn_sql(k: int, source: str = "vec", col: str = "f") -> str:
    return f"""nn AS (SELECT a.index AS src, b.index AS dst, list_distance(a.{col}, b.{col}) AS d,
  row_number() OVER (PARTITION BY a.index ORDER BY list_distance(a.{col}, b.{col}), b.index) AS rank
  FROM {source} a JOIN {source} b ON a.index <> b.index QUALIFY rank <= {k}),
kd AS (SELECT src AS index, max(d) AS kdist FROM nn GROUP BY src)"""


PREDICTIONS = """pred AS (SELECT CAST(doc_id AS BIGINT) AS id, CAST(quality AS INTEGER) AS y_true,
  CAST(toxic AS INTEGER) AS y_pred FROM labels)"""

SCORED = """scored AS (SELECT CAST(event_id AS BIGINT) AS id, CAST(value AS DOUBLE) AS score,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true FROM events)"""

RAW = """raw AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id,
  l_linestatus AS origin_file, l_returnflag AS label,
  CASE WHEN l_linenumber = 1 AND l_quantity = 1 THEN 'Infinity'
       WHEN l_linenumber = 2 AND l_quantity = 2 THEN 'bad'
       ELSE CAST(l_quantity AS VARCHAR) END AS c0,
  CAST(l_extendedprice AS DOUBLE) AS c1, CAST(l_discount AS DOUBLE) AS c2,
  CAST(l_tax AS DOUBLE) AS c3 FROM lineitem),
clean AS (SELECT *, CASE WHEN isfinite(try_cast(c0 AS DOUBLE)) THEN try_cast(c0 AS DOUBLE) END AS n0,
  CASE WHEN trim(label) <> 'N' THEN 1 ELSE 0 END AS y FROM raw)"""

PACKETS = """packets AS (SELECT CAST(event_id AS BIGINT) AS event_id,
  CASE WHEN event_type = 'error' THEN 'attack/a.pcap' ELSE 'benign/b.pcap' END AS pcap_path,
  epoch_us(ts) / 1e6 AS ts,
  CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (user_id % 20) ELSE '10.0.1.1' END AS src_ip,
  CASE WHEN event_id % 2 = 0 THEN '10.0.1.1' ELSE '10.0.0.' || (user_id % 20) END AS dst_ip,
  CAST(CASE WHEN event_id % 2 = 0 THEN 1024 + user_id % 20 ELSE 443 END AS INTEGER) AS sport,
  CAST(CASE WHEN event_id % 2 = 0 THEN 443 ELSE 1024 + user_id % 20 END AS INTEGER) AS dport,
  CASE event_type WHEN 'signup' THEN 17 WHEN 'view' THEN 1 ELSE 6 END AS proto,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value * 10) AS INTEGER) END AS ip_len,
  CAST(floor(value * 10) AS INTEGER) + 14 AS frame_len FROM events),
usable AS (SELECT *, coalesce(ip_len, frame_len) AS len FROM packets WHERE proto IN (6, 17)),
keyed AS (SELECT *,
  CASE WHEN (src_ip, sport) <= (dst_ip, dport) THEN src_ip ELSE dst_ip END AS ip1,
  CASE WHEN (src_ip, sport) <= (dst_ip, dport) THEN sport ELSE dport END AS p1,
  CASE WHEN (src_ip, sport) <= (dst_ip, dport) THEN dst_ip ELSE src_ip END AS ip2,
  CASE WHEN (src_ip, sport) <= (dst_ip, dport) THEN dport ELSE sport END AS p2 FROM usable)"""
