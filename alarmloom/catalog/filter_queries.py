"""Profiles, rules, alarm scores, curves and operating points on a given partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import metrics as me
from ..operators import neighbors as nb
from ..operators import scoring as sc
from ..operators.density import dbscan_sweep
from ..plans.experiment import BLENDS
from ..runtime import durable
from ..sources import adapters as ad
from .feature_queries import GRAPH_SQL, MERGE_SQL, median_size, selected
from .registry import ALARMS, PREDICTIONS, SCORED, SELECTED, knn_sql, query, r6

# --- SQL building blocks ----------------------------------------------------------------------------

PROFILE_SQL = """pts AS (SELECT v.*, kdist FROM vec v JOIN kd USING (index)),
long AS (SELECT index, given_cid, kdist, unnest(range(len(f))) AS p, unnest(f) AS x FROM pts),
cen AS (SELECT given_cid, p, avg(x) AS c FROM long GROUP BY 1, 2),
world AS (SELECT p, avg(x) AS g FROM long GROUP BY 1),
size AS (SELECT given_cid, count(*) AS n, avg(kdist) AS avg_kdist FROM pts GROUP BY 1),
anchor AS (SELECT p, c AS a FROM cen WHERE given_cid = (SELECT given_cid FROM size ORDER BY n DESC, given_cid LIMIT 1)),
own AS (SELECT index, given_cid, sqrt(sum((x - c) * (x - c))) AS d FROM long JOIN cen USING (given_cid, p) GROUP BY 1, 2),
far AS (SELECT given_cid, sqrt(sum((c - g) * (c - g))) AS dist_to_global, sqrt(sum((c - a) * (c - a))) AS dist_to_anchor
  FROM cen JOIN world USING (p) JOIN anchor USING (p) GROUP BY 1),
intra AS (SELECT given_cid, avg(d) AS avg_intra_dist, max(d) AS max_radius FROM own GROUP BY 1),
prof AS (SELECT given_cid AS cid, n AS size, avg_kdist, avg_intra_dist, max_radius, dist_to_global, dist_to_anchor,
  n / (avg_intra_dist + 1e-6) AS density_score FROM size JOIN intra USING (given_cid) JOIN far USING (given_cid))"""

RULES_SQL = """sig AS (SELECT cid, size, unnest(['intra', 'kdist', 'size', 'compact', 'isolation', 'density']) AS signal,
  unnest([avg_intra_dist, avg_kdist, size::DOUBLE, size / (avg_intra_dist * ln(1.0 + size) + 1e-10),
    avg_kdist / (avg_intra_dist + 1e-10), 1.0 * density_score / size]) AS raw FROM prof),
lim AS (SELECT signal, min(raw) AS lo, max(raw) AS hi FROM sig GROUP BY 1),
nrm AS (SELECT cid, size, signal, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0.5 END AS s FROM sig JOIN lim USING (signal)),
pair AS (SELECT cid, size, sum(s) / 2.0 AS s FROM nrm WHERE signal IN ('intra', 'kdist') GROUP BY 1, 2),
rules AS (
  SELECT cid, size, signal || CASE signal WHEN 'size' THEN '_large' ELSE '_high' END AS rule, s AS score FROM nrm
  UNION ALL SELECT cid, size, signal || CASE signal WHEN 'size' THEN '_small' ELSE '_low' END, 1.0 - s FROM nrm
  UNION ALL SELECT cid, size, 'combined_fwd', s FROM pair UNION ALL SELECT cid, size, 'combined_inv', 1.0 - s FROM pair),
pool AS (SELECT * FROM rules WHERE rule NOT LIKE 'density%'),
alarm AS (SELECT v.index AS id, v.y_true, r.rule, CASE WHEN r.size >= 5 THEN r.score ELSE 0.0 END AS score
  FROM vec v JOIN pool r ON v.given_cid = r.cid)"""

BASE = f"{SELECTED}, {knn_sql(10)}, {PROFILE_SQL}"
FULL = f"{BASE}, {RULES_SQL}"


def curve_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    whole = f"(PARTITION BY {by})" if by else "()"
    return f"""here AS (SELECT {b}score AS tau, count(*) AS n_here, count(*) FILTER (WHERE y_true = 0) AS fp_here,
  count(*) FILTER (WHERE y_true = 1) AS tp_here FROM {src} GROUP BY {b}score),
cur AS (SELECT {b}tau, n_here, fp_here, tp_here, sum(n_here) OVER w AS filtered_total, sum(fp_here) OVER w AS fp_removed,
  sum(tp_here) OVER w AS tp_removed, sum(fp_here) OVER {whole} AS fp_total, sum(tp_here) OVER {whole} AS tp_total,
  sum(n_here) OVER {whole} AS n_total FROM here WINDOW w AS ({part}ORDER BY tau DESC)),
curve AS (SELECT *, fp_removed / fp_total AS r_fpr, tp_removed / tp_total AS r_tpr,
  (fp_removed - fp_here) / fp_total AS pf, (tp_removed - tp_here) / tp_total AS pt FROM cur WHERE fp_total > 0 AND tp_total > 0),
area AS (SELECT {b}sum((r_tpr - pt) * (r_fpr + pf) / 2) AS auc FROM curve {'GROUP BY ' + by if by else ''})"""


POINT_SQL = """cand AS (SELECT *, r_fpr / greatest(r_tpr, 0.02) AS cer, CASE WHEN {ok} THEN 1 WHEN {near} THEN 2 ELSE 3 END AS tier FROM curve),
pt AS (SELECT * FROM cand QUALIFY row_number() OVER (ORDER BY tier,
  CASE WHEN tier < 3 THEN cer ELSE r_fpr - r_tpr END DESC, tau DESC) = 1)"""


# --- Spark building blocks ----------------------------------------------------------------------------

def given(x):
    return x.select(F.lit(0).cast("long").alias("run"), F.col("index").alias("id"),
                    F.col("given_cid").alias("cid"))


def profiled(spark, sf):
    """(selected alarms, membership, kdist, profiles) of the given partition."""
    x = selected(spark, sf)
    kd = durable(nb.kth_distance(nb.knn_join(x, None, 10, exclude_self=True)).select(
        F.col("src").alias("id"), "kdist"), "kdist")
    return x, given(x), kd, cl.cluster_profiles(x, given(x), kd)


def alarm_rule_scores(spark, sf, rules=None):
    x, m, kd, prof = profiled(spark, sf)
    scored = sc.score_clusters(durable(prof), rules)
    y = x.select(F.col("index").alias("id"), "y_true")
    return sc.alarm_scores(m, scored).join(y, "id"), kd


# --- profiles and rules --------------------------------------------------------------------------------

@query("ag1_cluster_profiles", f"""WITH {BASE} SELECT cid, size, round(ln(1.0 + size), 6) + 0.0 AS log_size,
  round(dist_to_global, 6) + 0.0 AS dist_to_global, round(dist_to_anchor, 6) + 0.0 AS dist_to_anchor,
  round(avg_intra_dist, 6) + 0.0 AS avg_intra_dist, round(max_radius, 6) + 0.0 AS max_radius,
  round(density_score, 4) + 0.0 AS density_score, round(density_score / size, 6) + 0.0 AS density_size,
  round(ln(1.0 + density_score), 6) + 0.0 AS log_density, round(avg_kdist, 6) + 0.0 AS avg_kdist FROM prof""")
def ag1(spark, sf):
    p = profiled(spark, sf)[3]
    return p.select("cid", "size", *[
        r6(c, 4 if c == "density_score" else 6).alias(c) for c in p.columns
        if c not in ("run", "cid", "size")])


def _signal(name, rules):
    listed = ", ".join(f"'{r}'" for r in rules)

    @query(name, f"WITH {FULL} SELECT cid, rule, round(score, 6) + 0.0 AS score FROM rules WHERE rule IN ({listed})")
    def run(spark, sf):
        return sc.score_clusters(profiled(spark, sf)[3], rules).select(
            "cid", "rule", r6("score").alias("score"))
    return run


_signal("sc2_density_signal", ["density_high", "density_low"])
_signal("sc3_intra_signal", ["intra_high", "intra_low"])
_signal("sc4_kdist_signal", ["kdist_high", "kdist_low"])
_signal("sc5_size_signal", ["size_small", "size_large"])
_signal("sc6_compact_signal", ["compact_high", "compact_low"])
_signal("sc7_isolation_signal", ["isolation_high", "isolation_low"])
_signal("sc8_combined_signal", ["combined_fwd", "combined_inv"])
_signal("sc9_rule_pool", sc.RULES)


@query("sc1_min_max_norm", """WITH per AS (SELECT user_id AS cid, avg(value) AS raw, 'spread' AS run FROM events GROUP BY user_id
  UNION ALL SELECT user_id, 1.0, 'constant' FROM events GROUP BY user_id),
lim AS (SELECT run, min(raw) AS lo, max(raw) AS hi FROM per GROUP BY 1),
n AS (SELECT run, cid, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0.5 END AS s FROM per JOIN lim USING (run))
SELECT run, CAST(cid AS BIGINT) AS cid, round(s, 6) + 0.0 AS norm, round(1.0 - s, 6) + 0.0 AS inverted FROM n""")
def sc1(spark, sf):
    per = ad.table(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("cid")).agg(
        F.avg("value").alias("avg_intra_dist"))
    rows = per.withColumn("run", F.lit("spread")).unionByName(
        per.withColumn("avg_intra_dist", F.lit(1.0)).withColumn("run", F.lit("constant")))
    rows = rows.withColumn("size", F.lit(1))
    s = sc.score_clusters(rows, ["intra_high", "intra_low"], kdist=False)
    return s.groupBy("run", "cid").agg(
        F.max(F.when(F.col("rule") == "intra_high", r6("score"))).alias("norm"),
        F.max(F.when(F.col("rule") == "intra_low", r6("score"))).alias("inverted"))


@query("jn7_cluster_score_lookup", f"""WITH {FULL} SELECT id, round(score, 6) + 0.0 AS score FROM alarm WHERE rule = 'size_large'""")
def jn7(spark, sf):
    s, _ = alarm_rule_scores(spark, sf, ["size_large"])
    return s.select("id", r6("score").alias("score"))


@query("sc10_alarm_scores", f"WITH {FULL} SELECT id, rule, round(score, 6) + 0.0 AS score FROM alarm")
def sc10(spark, sf):
    s, _ = alarm_rule_scores(spark, sf)
    return s.select("id", "rule", r6("score").alias("score"))


BLEND_SQL = f"""ke AS (SELECT min(kdist) AS lo, max(kdist) AS hi FROM kd),
mix AS (SELECT a.id, a.y_true, b.blend, (1.0 - b.blend) * a.score + b.blend * CASE WHEN hi > lo THEN (kdist - lo) / (hi - lo) ELSE 0.0 END AS score
  FROM alarm a JOIN kd ON a.id = kd.index, ke, (SELECT unnest([{', '.join(str(b) + '::DOUBLE' for b in BLENDS)}]) AS blend) b WHERE a.rule = 'intra_low')"""


def blend_rows(spark, sf):
    s, kd = alarm_rule_scores(spark, sf, ["intra_low"])
    return sc.blended(s, kd, BLENDS)


@query("sc11_sample_blend", f"WITH {FULL}, {BLEND_SQL} SELECT id, blend, round(score, 6) + 0.0 AS score FROM mix")
def sc11(spark, sf):
    return blend_rows(spark, sf).select("id", "blend", r6("score").alias("score"))


@query("sc12_fp_ratio_score", f"""WITH {ALARMS}, c AS (SELECT given_cid, count(*) AS n, count(*) FILTER (WHERE y_true = 0) / count(*) AS r FROM alarms GROUP BY 1)
SELECT index AS id, round(CASE WHEN n >= 5 THEN r ELSE 0.0 END, 6) + 0.0 AS score FROM alarms JOIN c USING (given_cid)""")
def sc12(spark, sf):
    a = ad.alarms(spark, sf)
    y = a.select(F.col("index").alias("id"), "y_true")
    return sc.fp_ratio_scores(given(a), y, 5).select("id", r6("score").alias("score"))


# --- curves -----------------------------------------------------------------------------------------------

@query("ev1_threshold_curve", f"""WITH {SCORED}, {curve_sql('scored')} SELECT tau, CAST(filtered_total AS BIGINT) AS filtered_total,
  CAST(fp_removed AS BIGINT) AS fp_removed, CAST(tp_removed AS BIGINT) AS tp_removed, round(r_fpr, 6) + 0.0 AS r_fpr,
  round(r_tpr, 6) + 0.0 AS r_tpr FROM curve""")
def ev1(spark, sf):
    return ev.threshold_curve(ad.scored(spark, sf)).select(
        "tau", "filtered_total", "fp_removed", "tp_removed", r6("r_fpr").alias("r_fpr"),
        r6("r_tpr").alias("r_tpr"))


@query("ev2_curve_auc", f"WITH {FULL}, {curve_sql('alarm', 'rule')} SELECT rule, round(auc, 6) + 0.0 AS auc FROM area")
def ev2(spark, sf):
    s, _ = alarm_rule_scores(spark, sf)
    return ev.curve_auc(ev.threshold_curve(s, ["rule"]), ["rule"]).select("rule", r6("auc").alias("auc"))


def _point(name, src, ok, near, **kw):
    sql = f"WITH {SCORED}, neg AS (SELECT id, -score AS score, y_true FROM scored), {curve_sql(src)}, " + POINT_SQL.format(ok=ok, near=near)

    @query(name, sql + """ SELECT tau, round(r_fpr, 6) + 0.0 AS r_fpr, round(r_tpr, 6) + 0.0 AS r_tpr,
  round(cer, 6) + 0.0 AS cer, round((SELECT auc FROM area), 6) + 0.0 AS auc FROM pt""")
    def run(spark, sf):
        s = ad.scored(spark, sf)
        if src == "neg":
            s = s.withColumn("score", -F.col("score"))
        p = ev.operating_point(ev.threshold_curve(s), **kw)
        return p.select("tau", r6("r_fpr").alias("r_fpr"), r6("r_tpr").alias("r_tpr"),
                        r6("CER").alias("cer"), r6("auc").alias("auc"))
    return run


_point("ev3_operating_point_budget", "scored", "r_tpr <= 0.5 AND r_fpr >= 0.3", "r_tpr <= 0.5", rtpr_budget=0.5)
_point("ev4_operating_point_legacy", "scored", "r_fpr >= 0.3 AND r_tpr >= 0.02", "false", rtpr_budget=None)
_point("ev5_fallback_budget", "neg", "r_tpr <= 0.1 AND r_fpr >= 0.3", "r_tpr <= 0.1")
_point("ev5_fallback_profit", "scored", "r_tpr <= 0.5 AND r_fpr >= 0.95 AND false", "false", rtpr_budget=None, min_rfpr=1.5)


@query("ev6_fixed_threshold", f"""WITH {SCORED} SELECT 100.0::DOUBLE AS tau, count(*) FILTER (WHERE score >= 100 AND y_true = 0) AS fp_removed,
  count(*) FILTER (WHERE score >= 100 AND y_true = 1) AS tp_removed,
  round(count(*) FILTER (WHERE score >= 100 AND y_true = 0) / count(*) FILTER (WHERE y_true = 0), 6) + 0.0 AS r_fpr,
  round(count(*) FILTER (WHERE score >= 100 AND y_true = 1) / count(*) FILTER (WHERE y_true = 1), 6) + 0.0 AS r_tpr FROM scored""")
def ev6(spark, sf):
    return ev.evaluate_at(ad.scored(spark, sf), 100.0).select(
        "tau", "fp_removed", "tp_removed", r6("r_fpr").alias("r_fpr"), r6("r_tpr").alias("r_tpr"))


@query("ev7_quantile_transfer", f"""WITH {SCORED}, v AS (SELECT * FROM scored WHERE id % 2 = 0), t AS (SELECT * FROM scored WHERE id % 2 = 1),
q AS (SELECT count(*) FILTER (WHERE score >= 120) / count(*) AS q FROM v),
l AS (SELECT list(score ORDER BY score) AS l FROM t), h AS (SELECT q, l, (len(l) - 1) * (1.0 - q) AS h FROM q, l)
SELECT round(q, 6) + 0.0 AS q, round(l[CAST(floor(h) AS INTEGER) + 1] + (h - floor(h)) * (l[CAST(ceil(h) AS INTEGER) + 1] - l[CAST(floor(h) AS INTEGER) + 1]), 6) + 0.0 AS tau FROM h""")
def ev7(spark, sf):
    s = ad.scored(spark, sf)
    q = s.filter("id % 2 = 0").agg(F.avg((F.col("score") >= 120).cast("int"))).head()[0]
    return ev.transfer_quantile(s.filter("id % 2 = 1"), q).select(
        r6(F.lit(q)).alias("q"), r6("tau").alias("tau"))


@query("ev8_fixed_points", f"""WITH {FULL}, s AS (SELECT * FROM alarm WHERE rule = 'combined_fwd')
SELECT tau, count(*) FILTER (WHERE score >= tau) AS n,
  round(count(*) FILTER (WHERE score >= tau AND y_true = 0) / count(*) FILTER (WHERE y_true = 0), 6) + 0.0 AS r_fpr,
  round(count(*) FILTER (WHERE score >= tau AND y_true = 1) / count(*) FILTER (WHERE y_true = 1), 6) + 0.0 AS r_tpr
FROM s, (SELECT unnest([0.9::DOUBLE, 0.8, 0.7, 0.5]) AS tau) GROUP BY tau HAVING count(*) FILTER (WHERE score >= tau) > 0""")
def ev8(spark, sf):
    s, _ = alarm_rule_scores(spark, sf, ["combined_fwd"])
    return ev.points_at(s).select("tau", "n", r6("r_fpr").alias("r_fpr"), r6("r_tpr").alias("r_tpr"))


# --- sweeps on a given partition ---------------------------------------------------------------------------

@query("blend_sweep_auc", f"WITH {FULL}, {BLEND_SQL}, {curve_sql('mix', 'blend')} SELECT blend, round(auc, 6) + 0.0 AS auc FROM area")
def blend_sweep(spark, sf):
    return ev.curve_auc(ev.threshold_curve(blend_rows(spark, sf), ["blend"]), ["blend"]).select(
        "blend", r6("auc").alias("auc"))


@query("rule_sweep_best", f"""WITH {FULL}, {curve_sql('alarm', 'rule')} SELECT rule, round(auc, 6) + 0.0 AS auc FROM area
QUALIFY row_number() OVER (ORDER BY round(auc, 9) DESC, list_position([{', '.join(repr(r) for r in sc.RULES)}], rule)) = 1""")
def rule_sweep(spark, sf):
    s, _ = alarm_rule_scores(spark, sf)
    area = ev.curve_auc(ev.threshold_curve(s, ["rule"]), ["rule"])
    pos = F.array_position(F.array(*[F.lit(r) for r in sc.RULES]), F.col("rule"))
    return area.agg(F.max_by(F.struct("rule", "auc"), F.struct(F.round("auc", 9), -pos)).alias("b")).select(
        "b.rule", r6("b.auc").alias("auc"))


@query("alarm_filter_given_partition", f"""WITH {FULL}, one AS (SELECT * FROM alarm WHERE rule = 'intra_low'), {curve_sql('one')},
{POINT_SQL.format(ok='r_tpr <= 0.1 AND r_fpr >= 0.3', near='r_tpr <= 0.1')}
SELECT round(tau, 6) + 0.0 AS tau, round(r_fpr, 6) + 0.0 AS r_fpr, round(r_tpr, 6) + 0.0 AS r_tpr, round(cer, 6) + 0.0 AS cer,
  round((SELECT auc FROM area), 6) + 0.0 AS auc FROM pt""")
def flagship(spark, sf):
    s, _ = alarm_rule_scores(spark, sf, ["intra_low"])
    p = ev.operating_point(ev.threshold_curve(s))
    return p.select(r6("tau").alias("tau"), r6("r_fpr").alias("r_fpr"), r6("r_tpr").alias("r_tpr"),
                    r6("CER").alias("cer"), r6("auc").alias("auc"))


@query("pipe15_score_and_evaluate", f"""WITH {FULL}, {BLEND_SQL}, half AS (SELECT * FROM mix WHERE blend = 0.5), {curve_sql('half')},
{POINT_SQL.format(ok='r_tpr <= 0.1 AND r_fpr >= 0.3', near='r_tpr <= 0.1')}
SELECT round(tau, 6) + 0.0 AS tau, round(r_fpr, 6) + 0.0 AS r_fpr, round(r_tpr, 6) + 0.0 AS r_tpr,
  round((SELECT auc FROM area), 6) + 0.0 AS auc, round(filtered_total / n_total, 6) + 0.0 AS quantile FROM pt""")
def score_and_evaluate(spark, sf):
    s, kd = alarm_rule_scores(spark, sf, ["intra_low"])
    p = ev.evaluate_scores(sc.blended(s, kd, [0.5]))
    return p.select(r6("tau").alias("tau"), r6("r_fpr").alias("r_fpr"), r6("r_tpr").alias("r_tpr"),
                    r6("auc").alias("auc"), r6("quantile").alias("quantile"))


# --- cluster operators --------------------------------------------------------------------------------------

@query("gr2_partition_quality", f"""WITH {SELECTED}, {knn_sql(10)}, {GRAPH_SQL},
e AS (SELECT w, a.given_cid AS c1, b.given_cid AS c2 FROM edges JOIN vec a ON src = a.index JOIN vec b ON dst = b.index),
c AS (SELECT c1, sum(w) AS k, sum(CASE WHEN c1 = c2 THEN w ELSE 0.0 END) AS inn FROM e GROUP BY 1), m AS (SELECT sum(w) AS m2 FROM e)
SELECT g.gamma, round((SELECT sum(inn) FROM c) / m2 - g.gamma * (SELECT sum(k * k) FROM c) / (m2 * m2), 6) + 0.0 AS quality
FROM m, (SELECT unnest([0.5::DOUBLE, 1.0, 10.0]) AS gamma) g""")
def gr2(spark, sf):
    x = selected(spark, sf)
    e = gr.knn_graph(nb.knn_join(x, None, 10, exclude_self=True))
    runs = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("run")
    edges = durable(e.select(runs, "src", "dst", "w"))
    m = x.select(runs, F.col("index").alias("id"), F.col("given_cid").alias("cid"))
    gamma = {0: 0.5, 1: 1.0, 2: 10.0}
    q = gr.partition_quality(edges, m, gamma)
    return q.select(gr.per_key("run", gamma).alias("gamma"), r6("quality").alias("quality"))


@query("gr5_singleton_fallback", f"WITH {ALARMS} SELECT index AS id, index AS cid FROM alarms")
def gr5(spark, sf):
    v = ad.alarms(spark, sf).select(F.lit(0).alias("graph"), F.col("index").alias("id"))
    return gr.singleton_communities(v).select("id", "cid")


@query("gr6_micro_cluster_merge", f"""WITH {SELECTED}, {MERGE_SQL}
SELECT index AS id, given_cid AS cid FROM core UNION ALL SELECT index, given_cid FROM won""")
def gr6(spark, sf):
    x = selected(spark, sf)
    near = durable(nb.knn_join(x, None, 30, exclude_self=True))
    return cl.merge_micro_clusters(x, given(x), [median_size(x)], near).select("id", "cid")


DB_EPS = 0.75


def dbscan_sql(eps: float) -> str:
    return f"""pairs AS (SELECT a.index AS a, b.index AS b FROM vec a JOIN vec b ON list_distance(a.f, b.f) <= {eps}),
core AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= 5),
link AS (SELECT a, b FROM pairs WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS cid FROM reach GROUP BY a),
border AS (SELECT p.a AS id, min(c.cid) AS cid FROM pairs p JOIN comp c ON p.b = c.id WHERE p.a NOT IN (FROM core) GROUP BY p.a),
dense AS (SELECT v.index AS id, coalesce(c.cid, b.cid, -1 - v.index) AS cid,
  CASE WHEN c.cid IS NOT NULL THEN 'core' WHEN b.cid IS NOT NULL THEN 'border' ELSE 'noise' END AS kind
  FROM vec v LEFT JOIN comp c ON v.index = c.id LEFT JOIN border b ON v.index = b.id)"""


@query("gr8_dbscan", f"WITH RECURSIVE {SELECTED}, {dbscan_sql(DB_EPS)} SELECT id, cid, kind FROM dense")
def gr8(spark, sf):
    return cl.dbscan(selected(spark, sf), DB_EPS).select("id", "cid", "kind")


SWEEP_EPS = [0.65, 0.67, 0.7, 0.75]


@query("gr8_density_sweep", " UNION ALL ".join(
    f"SELECT * FROM (WITH RECURSIVE {SELECTED}, {dbscan_sql(e)} SELECT {e}::DOUBLE AS eps, id, cid, kind FROM dense)"
    for e in SWEEP_EPS))
def gr8_sweep(spark, sf):
    """Density clusters at every radius, as cuts of one forest."""
    got = dbscan_sweep(selected(spark, sf), SWEEP_EPS)
    return got.select(gr.per_key("run", dict(enumerate(SWEEP_EPS))).alias("eps"), "id", "cid", "kind")


CC_EPS = 0.7


@query("gr9_connected_components", f"""WITH RECURSIVE {SELECTED},
link AS (SELECT a.index AS a, b.index AS b FROM vec a JOIN vec b ON list_distance(a.f, b.f) <= {CC_EPS}),
reach AS (SELECT index AS a, index AS b FROM vec UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS id, min(b) AS comp FROM reach GROUP BY a""")
def gr9(spark, sf):
    x = selected(spark, sf)
    g = F.lit(0).cast("long").alias("graph")
    links = nb.range_join(x, CC_EPS, mode="forest").select(g, "src", "dst")
    return gr.connected_components(links, x.select(g, F.col("index").alias("id"))).select("id", "comp")


@query("gr7_kmeans")
def gr7(spark, sf):
    return cl.kmeans(selected(spark, sf), 10)


# --- summaries ----------------------------------------------------------------------------------------------

@query("ag2_false_positives", f"""WITH {PREDICTIONS} SELECT count(*) AS num_samples, count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS num_fp,
  round(count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) / count(*), 6) + 0.0 AS fp_rate FROM pred""")
def ag2(spark, sf):
    return me.false_positive_stats(ad.predictions(spark, sf)).select(
        "num_samples", "num_fp", r6("fp_rate").alias("fp_rate"))


@query("ag2_label_counts", f"WITH {PREDICTIONS} SELECT y_true AS label, count(*) AS n FROM pred GROUP BY 1")
def ag2_counts(spark, sf):
    return me.label_counts(ad.predictions(spark, sf))


METRICS_SQL = """m AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1) AS tn,
  count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS fp, count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1) AS fn FROM pred),
r AS (SELECT *, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM m)"""


@query("ag3_binary_metrics", f"""WITH {PREDICTIONS}, {METRICS_SQL} SELECT tp, tn, fp, fn, round(accuracy, 6) + 0.0 AS accuracy,
  round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(recall, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) + 0.0 AS f1 FROM r""")
def ag3(spark, sf):
    m = me.binary_metrics(ad.predictions(spark, sf))
    return m.select("tp", "tn", "fp", "fn", *[r6(c).alias(c) for c in (
        "accuracy", "precision", "recall", "tpr", "fpr", "f1")])


def _summary(mode, keys):
    @query(f"ag4_cluster_summary_{mode}", f"""WITH c AS (SELECT user_id AS cid, count(*) AS size, count(*) FILTER (WHERE event_type <> 'error') AS fp_cnt,
  count(*) FILTER (WHERE event_type = 'error') AS tp_cnt FROM events GROUP BY 1),
r AS (SELECT *, fp_cnt / size AS fp_ratio, tp_cnt / size AS tp_ratio FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY {keys}, cid) AS pos FROM r)
SELECT CAST(pos AS INTEGER) AS pos, CAST(cid AS BIGINT) AS cid, size, fp_cnt, tp_cnt, round(fp_ratio, 6) + 0.0 AS fp_ratio, round(tp_ratio, 6) + 0.0 AS tp_ratio,
  round(sum(fp_cnt) OVER (ORDER BY pos) / (SELECT sum(fp_cnt) FROM c), 6) + 0.0 AS fp_cov,
  round(sum(tp_cnt) OVER (ORDER BY pos) / (SELECT sum(tp_cnt) FROM c), 6) + 0.0 AS tp_cov FROM o QUALIFY pos <= 50""")
    def run(spark, sf):
        e = ad.table(spark, sf, "events").select(
            F.col("user_id").cast("long").alias("cid"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"))
        s = me.cluster_summary(e, 50, mode)
        return s.select("pos", "cid", "size", "fp_cnt", "tp_cnt", *[r6(c).alias(c) for c in (
            "fp_ratio", "tp_ratio", "fp_cov", "tp_cov")])
    return run


_summary("fp_ratio", "fp_ratio DESC, fp_cnt DESC, size DESC")
_summary("fp_cnt", "fp_cnt DESC, fp_ratio DESC, size DESC")
_summary("size", "size DESC, fp_cnt DESC, fp_ratio DESC")
_summary("tp_cnt", "tp_cnt DESC, fp_ratio, size DESC")


def results(spark, sf):
    """Result-shaped rows: one per event, grouped like (dataset, model)."""
    e = ad.table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("dataset"),
        F.when(F.col("event_id") % 3 == 0, "svm").otherwise("ae").alias("model"),
        F.col("value").alias("auc"), (F.col("value") / 7).alias("cer"),
        F.when(F.col("event_id") % 5 != 0, F.col("value") / 500).alias("r_fpr"))


RESULTS_SQL = """res AS (SELECT event_type AS dataset, CASE WHEN event_id % 3 = 0 THEN 'svm' ELSE 'ae' END AS model, value AS auc,
  value / 7 AS cer, CASE WHEN event_id % 5 <> 0 THEN value / 500 END AS r_fpr FROM events)"""
STATS_SQL = ", ".join(f"round(avg({m}), 6) + 0.0 AS {m}_mean, round(stddev_samp({m}), 6) + 0.0 AS {m}_std" for m in ("auc", "cer", "r_fpr"))


@query("ag5_group_mean_std", f"WITH {RESULTS_SQL} SELECT dataset, model, count(*) AS n_rows, {STATS_SQL} FROM res GROUP BY 1, 2")
def ag5(spark, sf):
    s = me.group_summary(results(spark, sf), ["dataset", "model"], ["auc", "cer", "r_fpr"])
    return s.filter("overall = 0").select("dataset", "model", "n_rows", *[
        r6(f"{m}_{k}").alias(f"{m}_{k}") for m in ("auc", "cer", "r_fpr") for k in ("mean", "std")])


@query("ag6_overall_mean_std", f"WITH {RESULTS_SQL} SELECT dataset, model, count(*) AS n_rows, {STATS_SQL} FROM res GROUP BY GROUPING SETS ((dataset, model), ())")
def ag6(spark, sf):
    s = me.group_summary(results(spark, sf), ["dataset", "model"], ["auc", "cer", "r_fpr"])
    return s.select("dataset", "model", "n_rows", *[
        r6(f"{m}_{k}").alias(f"{m}_{k}") for m in ("auc", "cer", "r_fpr") for k in ("mean", "std")])


@query("ag7_best_method", f"""WITH {RESULTS_SQL}, u AS (SELECT dataset, model, unnest(['FILTER', 'IF', 'LOF']) AS m, unnest([1, 2, 3]) AS o,
  unnest([cer, r_fpr * 100, cer]) AS v FROM res), a AS (SELECT dataset, model, m, o, avg(v) AS v FROM u GROUP BY 1, 2, 3, 4)
SELECT dataset, model, m AS best_method, round(v, 6) + 0.0 AS best_auc FROM a QUALIFY row_number() OVER (PARTITION BY dataset, model ORDER BY v DESC, o) = 1""")
def ag7(spark, sf):
    r = results(spark, sf).withColumn("wide", F.col("r_fpr") * 100)
    return me.best_method(r, ["dataset", "model"], [("FILTER", "cer"), ("IF", "wide"), ("LOF", "cer")]).select(
        "dataset", "model", "best_method", r6("best_auc").alias("best_auc"))


def errors(spark, sf):
    return ad.scored(spark, sf).withColumnRenamed("score", "err")


@query("ag8_error_threshold", f"""WITH {SCORED} SELECT round(avg(score), 6) + 0.0 AS error_mean, round(stddev_pop(score), 6) + 0.0 AS error_std,
  round(quantile_cont(score, 0.99), 6) + 0.0 AS threshold FROM scored WHERE y_true = 0""")
def ag8(spark, sf):
    return me.error_threshold(errors(spark, sf)).select(
        *[r6(c).alias(c) for c in ("error_mean", "error_std", "threshold")])


@query("ag9_accuracy_threshold", f"""WITH {SCORED}, t AS (SELECT score AS threshold, count(*) FILTER (WHERE y_true = 1) AS p, count(*) FILTER (WHERE y_true = 0) AS n FROM scored GROUP BY 1),
c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER () AS fpr,
  sum(p) OVER () / (sum(p) OVER () + sum(n) OVER ()) AS s FROM t)
SELECT threshold, round(tpr * s + (1 - fpr) * (1 - s), 6) + 0.0 AS acc FROM c ORDER BY round(tpr * s + (1 - fpr) * (1 - s), 12) DESC, threshold DESC LIMIT 1""")
def ag9(spark, sf):
    return me.accuracy_threshold(errors(spark, sf)).select("threshold", r6("acc").alias("acc"))


@query("ag10_quantile_threshold", f"WITH {SCORED} SELECT round(quantile_cont(score, 0.95), 6) + 0.0 AS threshold FROM scored")
def ag10(spark, sf):
    return me.quantile_threshold(errors(spark, sf)).select(r6("threshold").alias("threshold"))


@query("ag11_anomaly_probability", f"""WITH {SCORED}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM scored)
SELECT id, round((score - lo) / (hi - lo), 6) + 0.0 AS proba_pos, round(1 - (score - lo) / (hi - lo), 6) + 0.0 AS proba_neg FROM scored, m""")
def ag11(spark, sf):
    return me.anomaly_probability(errors(spark, sf)).select(
        "id", r6("proba_pos").alias("proba_pos"), r6("proba_neg").alias("proba_neg"))
