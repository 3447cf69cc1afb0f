"""Feature transforms, nearest-neighbour joins and graphs over the alarm view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import graph as gr
from ..operators import neighbors as nb
from ..sources import adapters as ad
from ..runtime import durable
from .registry import ALARMS, CELLS, NORMED, RAW, SELECTED, knn_sql, query, r6


def selected(spark: SparkSession, sf: str, keep: tuple = ("index", "y_true", "given_cid")) -> DataFrame:
    """Scaled alarms on their 20 most variable dimensions."""
    x = durable(fe.minmax_log(ad.alarms(spark, sf).select(*keep, "features")), "scaled")
    return durable(fe.keep_dims(x, fe.top_variance_dims(x, 20)), "selected")


def neighbours(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return nb.knn_join(selected(spark, sf), None, k, exclude_self=True)


@query("fea1_minmax_log", f"WITH {NORMED} SELECT index, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS value FROM normed")
def fea1(spark, sf):
    x = durable(fe.minmax_log(ad.alarms(spark, sf).select("index", "features")), "scaled")
    return fe.exploded(x, ["index"]).select("index", "dim", r6("value").alias("value"))


@query("fea2_top_variance", f"""WITH {NORMED} SELECT CAST(row_number() OVER (ORDER BY var_pop(v) DESC, dim) AS INTEGER) AS pos,
  CAST(dim AS INTEGER) AS dim, round(var_pop(v), 6) + 0.0 AS variance FROM normed GROUP BY dim QUALIFY pos <= 20""")
def fea2(spark, sf):
    x = durable(fe.minmax_log(ad.alarms(spark, sf).select("index", "features")))
    dims = fe.top_variance_dims(x, 20)
    pos = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(d).alias("dim"))
                              for i, d in enumerate(dims)]))
    var = x.agg(*[F.var_pop(F.col("features")[d]).alias(f"v{d}") for d in dims])
    pick = F.create_map(*[e for d in dims for e in (F.lit(d), F.col(f"v{d}"))])
    return var.select(pos.alias("e"), pick.alias("m")).select(
        "e.pos", "e.dim", r6(F.element_at("m", F.col("e.dim"))).alias("variance"))


@query("fea3_ks_statistic", f"""WITH {CELLS},
h AS (SELECT dim, v, count(*) FILTER (WHERE y_true = 0) AS n0, count(*) FILTER (WHERE y_true = 1) AS n1 FROM cells GROUP BY dim, v),
c AS (SELECT dim, sum(n0) OVER w / sum(n0) OVER (PARTITION BY dim) AS f0, sum(n1) OVER w / sum(n1) OVER (PARTITION BY dim) AS f1
  FROM h WINDOW w AS (PARTITION BY dim ORDER BY v))
SELECT CAST(dim AS INTEGER) AS dim, round(max(abs(f0 - f1)), 6) + 0.0 AS ks FROM c GROUP BY dim""")
def fea3(spark, sf):
    return fe.ks_statistics(ad.alarms(spark, sf)).select("dim", r6("ks").alias("ks"))


@query("fea4_robust_z", """WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events),
a AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM events, m)
SELECT CAST(event_id AS BIGINT) AS id, round(0.6745 * (value - med) / CASE WHEN mad > 1e-12 THEN mad ELSE 1.0 END, 6) + 0.0 AS z
FROM events, m, a""")
def fea4(spark, sf):
    return fe.robust_z(ad.scored(spark, sf), "score").select("id", r6("z").alias("z"))




@query("fea5_bit_encoding", f"""WITH {RAW},
v AS (SELECT row_id, CAST(trunc(coalesce(n0, 0)) AS BIGINT) AS a, CAST(floor(trunc(c1) / 1000) AS BIGINT) AS b,
  CAST(trunc(c2 * 100) AS BIGINT) AS c FROM clean),
k AS (SELECT row_id, least(greatest(a, 0), 255) AS a, least(greatest(b, 0), 16777215) AS b, least(greatest(c, 0), 15) AS c FROM v)
SELECT row_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN ((CASE WHEN pos < 8 THEN a >> (7 - pos) WHEN pos < 32 THEN b >> (31 - pos)
  ELSE c >> (35 - pos) END) & 1) = 1 THEN 1 ELSE -1 END AS TINYINT) AS bit FROM k, range(36) t(pos)""")
def fea5(spark, sf):
    from ..functions.scalars import number_or_null
    raw = ad.raw_flows(spark, sf).select("row_id", F.array(
        number_or_null(F.col("c0")), F.col("c1"), F.col("c2") * 100).alias("features"))
    bits = fe.bit_encode(raw, [(0, 8, False), (1, 24, True), (2, 4, False)])
    return bits.select("row_id", F.posexplode("bits").alias("pos", "bit"))


# Generic profile inputs over the line items: name (its words choose the width) and value.
PROFILE_INPUTS = [("flag_qty", "l_quantity"), ("net_load", "l_extendedprice"), ("duration", "l_linenumber * 1000"), ("tax", "l_tax * 100")] * 5


@query("fea6_bit_profile", f"""WITH x AS (SELECT unnest([{', '.join(f"({e})::DOUBLE" for _, e in PROFILE_INPUTS)}]) AS v, unnest(range(20)) AS pos FROM lineitem),
w AS (SELECT pos, v, CASE pos % 4 WHEN 0 THEN 8 WHEN 1 THEN 24 ELSE 16 END AS bits, pos % 4 = 1 AS scaled FROM x),
c AS (SELECT pos, bits, scaled, least(floor(CASE WHEN scaled THEN v / 1000 ELSE v END), 2 ** bits - 1)::BIGINT AS value FROM w)
SELECT CAST(pos AS INTEGER) AS pos, CAST(bits AS INTEGER) AS bits, scaled, CAST(sum(bit_count(value)) AS BIGINT) AS set_bits, count(*) AS n FROM c GROUP BY ALL""")
def fea6(spark, sf):
    """The generic profile applied to every line item: set bits of each encoded input."""
    li = ad.table(spark, sf, "lineitem")
    rows = li.select(F.array(*[F.expr(e).cast("double") for _, e in PROFILE_INPUTS]).alias("features"))
    profile = fe.bit_profile("kdd", [f"{n}_{i}" for i, (n, _) in enumerate(PROFILE_INPUTS)])
    ends = [sum(b for _, b, _ in profile[:i]) for i in range(len(profile))]
    # counted where they are encoded: twenty sums go on, not twenty rows for each item, and no bit is written
    ones = [F.size(F.filter(F.slice("bits", at + 1, b), lambda x: x > 0)).alias(f"o{p}") for (p, b, _), at in zip(profile, ends)]
    sums = fe.bit_encode(rows, profile).select(*ones).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"o{p}").alias(f"o{p}") for p, _, _ in profile])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(b).alias("bits"), F.lit(s).alias("scaled"), F.col(f"o{p}").alias("set_bits"))
                               for p, b, s in profile])).alias("c")
    return sums.filter("n > 0").select(each, "n").select("c.*", "n")


@query("fea7_standardize", f"""WITH {CELLS}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM cells GROUP BY dim)
SELECT index, CAST(dim AS INTEGER) AS dim, round((v - m) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6) + 0.0 AS value FROM cells JOIN s USING (dim)""")
def fea7(spark, sf):
    a = ad.alarms(spark, sf).select("index", "features")
    x = durable(fe.standardize(a, fe.standardize_fit(a)), "scaled")
    return fe.exploded(x, ["index"]).select("index", "dim", r6("value").alias("value"))


@query("jn1_knn_self_join", f"""WITH {ALARMS}, {knn_sql(10, 'alarms', 'features')}
SELECT src, dst, round(d, 6) + 0.0 AS d, CAST(rank AS INTEGER) AS rank FROM nn""")
def jn1(spark, sf):
    x = ad.alarms(spark, sf).select("index", "features")
    return nb.knn_join(x, None, 10, exclude_self=True).select("src", "dst", r6("d").alias("d"), "rank")


@query("jn2_kth_distance", f"WITH {SELECTED}, {knn_sql(10)} SELECT index AS id, round(kdist, 6) + 0.0 AS kdist FROM kd")
def jn2(spark, sf):
    return nb.kth_distance(neighbours(spark, sf)).select(
        F.col("src").alias("id"), r6("kdist").alias("kdist"))


GRAPH_SQL = """und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(least(1.0 / (d + 1e-4), 1e4)) AS w FROM nn GROUP BY 1, 2),
edges AS (SELECT a AS src, b AS dst, w FROM und UNION ALL SELECT b, a, w FROM und)"""


@query("jn3_knn_graph", f"WITH {SELECTED}, {knn_sql(10)}, {GRAPH_SQL} SELECT src, dst, round(w, 6) + 0.0 AS w FROM edges")
def jn3(spark, sf):
    return gr.knn_graph(neighbours(spark, sf)).select("src", "dst", r6("w").alias("w"))


@query("jn4_knn_to_reference", f"""WITH {ALARMS}, q AS (SELECT * FROM alarms WHERE y_true = 0), r AS (SELECT * FROM alarms WHERE y_true = 1)
SELECT q.index AS src, r.index AS dst, round(list_distance(q.features, r.features), 6) + 0.0 AS d,
  CAST(row_number() OVER (PARTITION BY q.index ORDER BY list_distance(q.features, r.features), r.index) AS INTEGER) AS rank
FROM q JOIN r ON true QUALIFY rank <= 5""")
def jn4(spark, sf):
    a = ad.alarms(spark, sf)
    q, r = a.filter("y_true = 0"), a.filter("y_true = 1")
    return nb.knn_join(q, r, 5).select("src", "dst", r6("d").alias("d"), "rank")


EPS = 0.9


@query("jn5_range_join", f"""WITH {SELECTED} SELECT a.index AS src, b.index AS dst, round(list_distance(a.f, b.f), 6) + 0.0 AS d
FROM vec a JOIN vec b ON list_distance(a.f, b.f) <= {EPS} WHERE a.index <> b.index""")
def jn5(spark, sf):
    return nb.range_join(selected(spark, sf), EPS).filter("src <> dst").select(
        "src", "dst", r6("d").alias("d"))


@query("jn5_range_counts", f"""WITH {SELECTED} SELECT a.index AS src, count(*) AS n FROM vec a JOIN vec b
ON list_distance(a.f, b.f) <= {EPS} GROUP BY a.index""")
def jn5_counts(spark, sf):
    return nb.range_join(selected(spark, sf), EPS, "count").select("src", F.col("n").cast("long").alias("n"))




MERGE_SQL = f"""sizes AS (SELECT given_cid, count(*) AS n FROM alarms GROUP BY given_cid),
limits AS (SELECT quantile_cont(n, 0.5) AS cut FROM sizes),
core AS (SELECT v.index, v.f, v.given_cid FROM vec v JOIN sizes USING (given_cid), limits WHERE n >= cut),
micro AS (SELECT v.index, v.f, v.given_cid FROM vec v JOIN sizes USING (given_cid), limits WHERE n < cut),
near AS (SELECT m.index, c.given_cid, row_number() OVER (PARTITION BY m.index ORDER BY list_distance(m.f, c.f), c.index) AS rk
  FROM micro m JOIN core c ON true QUALIFY rk <= 5),
votes AS (SELECT index, given_cid, count(*) AS c FROM near GROUP BY 1, 2),
won AS (SELECT index, given_cid FROM votes QUALIFY row_number() OVER (PARTITION BY index ORDER BY c DESC, given_cid) = 1)"""


def median_size(x: DataFrame) -> int:
    """Minimum size that makes about half of the given partitions micro-clusters."""
    sizes = sorted(r["count"] for r in x.groupBy("given_cid").count().collect())
    mid = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
    return -int(-mid // 1)


@query("jn6_majority_vote", f"WITH {SELECTED}, {MERGE_SQL} SELECT index AS id, given_cid AS cid FROM won")
def jn6(spark, sf):
    x = selected(spark, sf)
    cut = median_size(x)
    big = [r["given_cid"] for r in x.groupBy("given_cid").count().filter(F.col("count") >= cut).collect()]
    core, micro = x.filter(F.col("given_cid").isin(big)), x.filter(~F.col("given_cid").isin(big))
    return nb.majority_vote(micro, core, "given_cid").select(
        F.col("src").alias("id"), F.col("given_cid").alias("cid"))


@query("gr3_average_degree", f"""WITH {SELECTED}, {knn_sql(10)}, {GRAPH_SQL}
SELECT round((SELECT count(*) FROM edges) * 1.0 / (SELECT count(*) FROM vec), 6) + 0.0 AS avg_degree,
  (SELECT count(*) FROM edges) * 1.0 / (SELECT count(*) FROM vec) > 25 AS too_dense""")
def gr3(spark, sf):
    x = selected(spark, sf)
    e = gr.knn_graph(nb.knn_join(x, None, 10, exclude_self=True))
    v = x.select(F.lit(0).cast("long").alias("graph"), F.col("index").alias("id"))
    return gr.average_degree(e, v).select(
        r6("avg_degree").alias("avg_degree"), (F.col("avg_degree") > 25).alias("too_dense"))


