"""Community detection, baselines, detectors, sweeps, experiments, ablations and the online filter."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import baselines as bl
from ..operators import features as fe
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import neighbors as nb
from ..operators import scoring as sc
from ..plans import ablation as ab
from ..plans import batch as ba
from ..plans import experiment as ex
from ..plans.generate import generate_alarms
from ..runtime import durable, local_rows, scratch_path, side_by_side
from ..sources import adapters as ad
from ..sources import alarm_sets as al
from ..streaming.online import filter_batch, filter_stream
from .feature_queries import GRAPH_SQL, selected
from .filter_queries import PROFILE_SQL, RULES_SQL, curve_sql, dbscan_sql
from .ingest_queries import key
from .registry import ALARMS, NORMED, SELECTED, knn_sql, query, r6

GRID = ex.Grid()


def prepared(spark, sf):
    return ex.prepare(ad.alarms(spark, sf), GRID)


def swept(spark, sf):
    data = prepared(spark, sf)
    return data, ex.graph_clusterings(data.sweep, list(GRID.ks), list(GRID.resolutions), GRID)


def chosen(spark, sf):
    data, c = swept(spark, sf)
    return data, c, ex.search(data.sweep, c, GRID)


def finished(spark, sf):
    data, c, choice = chosen(spark, sf)
    return data, ex.finalize(data, choice, GRID, c)


def described(got, names=("tau", "r_fpr", "r_tpr", "CER", "auc")):
    """Metrics next to the configuration they belong to."""
    choice, metrics = got
    return metrics.select(
        *[r6(c).alias(c.lower()) for c in names], F.lit(str(choice.cell)).alias("cell"),
        F.lit(choice.min_size).alias("min_size"), F.lit(choice.rule).alias("rule"),
        F.lit(choice.blend).alias("blend"))


# --- graph -----------------------------------------------------------------------------------------------

@query("gr1_communities")
def gr1(spark, sf):
    x = selected(spark, sf)
    knn = durable(nb.knn_join(x, None, 10, exclude_self=True))
    edges = durable(gr.knn_graph(knn, [10]))
    v = x.select(F.lit(10).cast("long").alias("graph"), F.col("index").alias("id"))
    m = gr.communities(edges, v, [(0, 10, 0.5), (1, 10, 1.0), (2, 10, 10.0)])
    return m.select(gr.per_key("run", {0: 0.5, 1: 1.0, 2: 10.0}).alias("resolution"), "id", "cid")


@query("gr4_resolution_guard", f"""WITH {SELECTED}, {knn_sql(30)}, {GRAPH_SQL},
g AS (SELECT (SELECT count(*) FROM edges) * 1.0 / (SELECT count(*) FROM vec) > 25 AS dense),
r AS (SELECT unnest([0.5::DOUBLE, 1.0, 10.0]) AS resolution)
SELECT resolution, NOT (dense AND resolution >= 10) AS in_sweep, CASE WHEN dense AND resolution >= 10 THEN 0.5::DOUBLE ELSE resolution END AS final_resolution FROM r, g""")
def gr4(spark, sf):
    x = selected(spark, sf)
    edges = durable(gr.knn_graph(nb.knn_join(x, None, 30, exclude_self=True)))
    v = x.select(F.lit(0).cast("long").alias("graph"), F.col("index").alias("id"))
    dense = 0 in gr.dense_graphs(edges, v)
    listed = [0.5, 1.0, 10.0]
    use = gr.usable_resolutions(listed, dense)
    return local_rows(spark, [
        (r, r in use, gr.fallback_resolution(r, dense, listed)) for r in listed],
        "resolution double, in_sweep boolean, final_resolution double")


# --- baselines ----------------------------------------------------------------------------------------------

def halves(spark, sf):
    """Scaled alarms cut in two by id: reference rows and scored rows."""
    x = durable(fe.minmax_log(ad.alarms(spark, sf).select("index", "y_true", "features")))
    return x.filter("index % 2 = 0"), x.filter("index % 2 = 1")


REF_SQL = f"""{NORMED}, full_vec AS (SELECT index, y_true, list(v ORDER BY dim) AS f FROM normed GROUP BY 1, 2),
r AS (SELECT * FROM full_vec WHERE index % 2 = 0), q AS (SELECT * FROM full_vec WHERE index % 2 = 1)"""

LOF_SQL = """own AS (SELECT a.index AS src, b.index AS dst, list_distance(a.f, b.f) AS d,
  row_number() OVER (PARTITION BY a.index ORDER BY list_distance(a.f, b.f), b.index) AS rk FROM r a JOIN r b ON a.index <> b.index QUALIFY rk <= 30),
ks AS (SELECT unnest([10, 20, 30]) AS k), ko AS (SELECT k, src, dst, d FROM own JOIN ks ON rk <= k),
kd AS (SELECT k, src, max(d) AS kd FROM ko GROUP BY 1, 2),
lrd AS (SELECT o.k, o.src, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM ko o JOIN kd ON o.k = kd.k AND o.dst = kd.src GROUP BY 1, 2),
seen AS (SELECT a.index AS src, b.index AS dst, list_distance(a.f, b.f) AS d,
  row_number() OVER (PARTITION BY a.index ORDER BY list_distance(a.f, b.f), b.index) AS rk FROM {who} a JOIN r b ON true QUALIFY rk <= 30),
sk AS (SELECT k, src, dst, d FROM seen JOIN ks ON rk <= k),
mine AS (SELECT s.k, s.src, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS m, avg(lrd) AS o FROM sk s JOIN kd ON s.k = kd.k AND s.dst = kd.src
  JOIN lrd ON s.k = lrd.k AND s.dst = lrd.src GROUP BY 1, 2)
SELECT k, src AS id, round(-(o / m), 6) + 0.0 AS score FROM mine"""


@query("bl1_isolation_forest")
def bl1(spark, sf):
    r, q = halves(spark, sf)
    return bl.isolation_scores(r, q)


@query("bl2_lof_new_rows", f"WITH {REF_SQL}, {LOF_SQL.format(who='q')}")
def bl2(spark, sf):
    r, q = halves(spark, sf)
    return bl.lof_scores(r, q, [10, 20, 30], r.count()).select("k", "id", r6("score").alias("score"))


@query("bl2_lof_reference_rows", f"WITH {REF_SQL}, {LOF_SQL.format(who='r')}")
def bl2_own(spark, sf):
    r, _ = halves(spark, sf)
    return bl.lof_scores(r, None, [10, 20, 30], r.count()).select("k", "id", r6("score").alias("score"))


KNN_SCORE_SQL = """seen AS (SELECT a.index AS id, list_distance(a.f, b.f) AS d,
  row_number() OVER (PARTITION BY a.index ORDER BY list_distance(a.f, b.f), b.index) AS rk FROM {who} a JOIN r b ON true)"""


@query("bl3_knn_distance", f"""WITH {REF_SQL}, {KNN_SCORE_SQL.format(who='q')}
SELECT CAST(rk AS INTEGER) AS k, id, round(-d, 6) + 0.0 AS score FROM seen WHERE rk IN (5, 10, 20)""")
def bl3(spark, sf):
    r, q = halves(spark, sf)
    return bl.knn_distance_scores(r, q, [5, 10, 20], r.count()).select("k", "id", r6("score").alias("score"))


@query("bl4_tuned_knn_baseline", f"""WITH {REF_SQL}, {KNN_SCORE_SQL.format(who='r')},
s AS (SELECT rk AS k, -d AS score, y_true FROM seen JOIN r ON id = index WHERE rk IN (5, 10, 20)), {curve_sql('s', 'k')}
SELECT CAST(k AS INTEGER) AS k, round(auc, 6) + 0.0 AS val_auc FROM area ORDER BY round(auc, 12) DESC, k LIMIT 1""")
def bl4(spark, sf):
    r, q = halves(spark, sf)
    n = r.count()
    best, _ = ex.tune_baseline(ex._knn_baseline(n), [5, 10, 20], r, q)
    own = bl.knn_distance_scores(r, None, [best], n).join(r.select(F.col("index").alias("id"), "y_true"), "id")
    return ev.curve_auc(ev.threshold_curve(own)).select(F.lit(best).alias("k"), r6("auc").alias("val_auc"))


# --- detectors -------------------------------------------------------------------------------------------------

def flow_rows(spark, sf):
    """Line items as a labelled table: returned goods are the malicious class."""
    li = ad.table(spark, sf, "lineitem")
    key = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    x = [F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), day,
         F.col("l_linenumber")]
    return li.select(key.alias("index"), F.array(*[c.cast("double") for c in x]).alias("features"),
                     (F.col("l_returnflag") != "N").cast("int").alias("y_true"))


def _detector(name, kind, **params):
    @query(name)
    def run(spark, sf):
        pred, metrics, _ = generate_alarms(flow_rows(spark, sf), kind, **params)
        return metrics.select("tp", "tn", "fp", "fn", *[
            r6(c).alias(c) for c in ("accuracy", "precision", "recall", "fpr", "f1")])
    return run


_detector("ml1_random_forest", "rf")
_detector("ml2_linear_svm", "svm")
_detector("ml3_decision_tree", "tree")
_detector("ml4_boosted_trees", "xgb", maxIter=50)  # a tenth of the operator's default of 500 rounds, which run one after the other
_detector("ml5_reconstruction_error", "ae", components=3)


def wide_rows(spark, sf):
    """Twenty numbers of every line item and their names, for the generic bit profile."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    cells = {
        "quantity": quantity, "price_load": price, "discount": F.col("l_discount") * 100, "tax": F.col("l_tax") * 100,
        "ship_day": day("l_shipdate"), "line_flag": F.col("l_linenumber"), "part": F.col("l_partkey"),
        "supplier": F.col("l_suppkey"), "order": F.col("l_orderkey"), "unit_price": price / quantity,
        "net_load": price * (1 - F.col("l_discount")), "gross_load": price * (1 + F.col("l_tax")),
        "month": F.month(F.col("l_shipdate").cast("date")), "weekday": F.dayofweek(F.col("l_shipdate").cast("date")),
        "year": F.year(F.col("l_shipdate").cast("date")), "day_of_month": F.dayofmonth(F.col("l_shipdate").cast("date")),
        "price_rate": F.sqrt(price), "status_state": F.ascii("l_linestatus"), "part_group": F.col("l_partkey") % 25,
        "log_price": F.log1p(price) * 100,
    }
    li = ad.table(spark, sf, "lineitem")
    key = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("index")
    label = (F.col("l_returnflag") != "N").cast("int").alias("y_true")
    return li.select(key, F.array(*[c.cast("double") for c in cells.values()]).alias("features"), label), list(cells)


@query("ml6_bit_perceptron")
def ml6(spark, sf):
    wide, names = wide_rows(spark, sf)
    pred, metrics, _ = generate_alarms(wide, "n3ic", dataset="kdd", columns=names)
    return metrics.select("tp", "tn", "fp", "fn", r6("accuracy").alias("accuracy"))


@query("ml7_generate_alarms")
def ml7(spark, sf):
    """Alarm generation with its exports, read back."""
    out = scratch_path(spark, "generated")
    generate_alarms(flow_rows(spark, sf), "svm", out_dir=out)
    return al.load_alarms(spark, f"{out}/alert.json", lines=True)


# --- sweeps and experiments ------------------------------------------------------------------------------------------

PREPARED_SQL = f"""{ALARMS}, cut AS (SELECT index, y_true, features, CASE WHEN row_number() OVER (PARTITION BY y_true ORDER BY {key(42, 'index')}, index)
  <= ceil(count(*) OVER (PARTITION BY y_true) * 0.7) THEN 'test' ELSE 'val' END AS part FROM alarms),
long AS (SELECT index, y_true, part, unnest(features) AS raw, generate_subscripts(features, 1) - 1 AS dim FROM cut),
finite AS (SELECT * REPLACE (CASE WHEN isfinite(raw) THEN raw ELSE 0.0 END AS raw) FROM long),
ends AS (SELECT part, dim, min(raw) AS lo, max(raw) AS hi FROM finite GROUP BY 1, 2),
scaled AS (SELECT index, y_true, part, dim, log2(1 + least(greatest((raw - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 0), 1)) AS v
  FROM finite JOIN ends USING (part, dim)),
top AS (SELECT dim, row_number() OVER (ORDER BY var_pop(v) DESC, dim) AS pos FROM scaled WHERE part = 'val' GROUP BY dim QUALIFY pos <= 20),
prep AS (SELECT part, index, y_true, count(*) AS dims, sum(v * pos) AS mark FROM scaled JOIN top USING (dim) GROUP BY 1, 2, 3)"""


@query("pipe12_prepare_data", f"""WITH {PREPARED_SQL}
SELECT part, index, y_true, CAST(dims AS INTEGER) AS dims, round(mark, 6) + 0.0 AS mark FROM prep
UNION ALL SELECT 'sweep', index, y_true, CAST(dims AS INTEGER), round(mark, 6) + 0.0 FROM prep WHERE part = 'val'""")
def pipe12(spark, sf):
    """Both sides, scaled on themselves and cut to the features of most variance; mark weighs these by their rank."""
    d = prepared(spark, sf)
    parts = {"val": d.val, "test": d.test, "sweep": d.sweep}
    mark = F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    rows = [p.select(F.lit(n).alias("part"), "index", "y_true", F.size("features").alias("dims"), r6(mark).alias("mark"))
            for n, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("pipe13_cluster_one_cell")
def pipe13(spark, sf):
    d, c = swept(spark, sf)
    one = ex.chosen_cell(c, ex.Choice({"k": 10, "res": 1.0}, 5, "intra_low"))
    return one.membership.join(one.kdist, ["run", "id"]).select("id", "cid", r6("kdist").alias("kdist"))


@query("pipe1_clustering_sweep")
def pipe1(spark, sf):
    d, c = swept(spark, sf)
    auc, made = ex.sweep_auc(d.sweep, c, list(GRID.min_sizes), list(GRID.rules))
    cells = local_rows(spark, [(i, v["k"], v["res"], v["min_size"]) for i, v in made.index.items()],
                       "cell long, k int, resolution double, min_size int")
    return auc.join(F.broadcast(cells), "cell").select("k", "resolution", "min_size", "rule", r6("auc").alias("auc"))


@query("pipe2_blend_sweep")
def pipe2(spark, sf):
    d, c, choice = chosen(spark, sf)
    one = ex.chosen_cell(c, choice)
    rows = ex.cell_alarms(d.sweep, ex.cluster_cells(d.sweep, one, [choice.min_size], [choice.rule]))
    mixed = sc.blended(rows.select("id", "cid", "y_true", "score"), one.kdist.select("id", "kdist"),
                       [0.0, *GRID.blends], by=[])
    return ev.curve_auc(ev.threshold_curve(mixed, ["blend"]), ["blend"]).select("blend", r6("auc").alias("auc"))


@query("pipe3_frozen_test_metrics")
def pipe3(spark, sf):
    return described(finished(spark, sf)[1])


@query("pipe14_full_method")
def pipe14(spark, sf):
    d, c = swept(spark, sf)
    return described(ex.run_filter(d, ex.Grid(quantile_tau=True), c))


@query("pipe4_single_experiment")
def pipe4(spark, sf):
    """One result row: the filter and the three baselines on the same split; here a row per method."""
    got = ex.run_experiment(ad.alarms(spark, sf), GRID)
    rows = [(m.upper(), *[got[f"{m}_{x}"] for x in ("R.FPR", "R.TPR", "CER", "auc")]) for m in ("filter", "if", "lof", "knn")]
    out = local_rows(spark, rows, "method string, r_fpr double, r_tpr double, cer double, auc double")
    return out.select("method", *[r6(c).alias(c) for c in ("r_fpr", "r_tpr", "cer", "auc")])


def experiment_tree(spark, sf, sets=(("vec", 16), ("vec", 17), ("root", 16))):
    """All alarms in the experiment layout: as they are and with square roots, and in two orders of dimensions."""
    root = scratch_path(spark, "experiments")
    for name, seed in sets:
        x = F.transform("features", lambda v: F.signum(v) * F.sqrt(F.abs(v))) if name == "root" else F.col("features")
        rows = ad.alarms(spark, sf).withColumn("features", F.reverse(x) if seed % 2 else x)
        al.save_alarms(rows, f"{root}/{name}-csv-svm/split_seed{seed}/alert.json")
    return root


@query("pipe5_batch_runner")
def pipe5(spark, sf):
    """Two datasets, one of them with two seeds; the second call finds all tags done and adds nothing."""
    root, out = experiment_tree(spark, sf), scratch_path(spark, "batch")
    ba.run_batch(spark, root, out, GRID)
    done = ba.run_batch(spark, root, out, GRID)
    return ba.summarise(done).select("dataset", "model", "n_rows", *[
        r6(f"`{m}_auc_{k}`").alias(f"{m}_auc_{k}") for m in ("filter", "if", "lof", "knn") for k in ("mean", "std")])


@query("pipe6_without_feature_selection")
def pipe6(spark, sf):
    return described(ab.without_features(ad.alarms(spark, sf), GRID))


ABLATION_EPS = [0.65, 0.67, 0.7]


def dense_alarms_sql(eps: float) -> str:
    """Density clusters, merged below five rows, profiled and scored by every rule."""
    profiles, rules = (part.replace("FROM vec v", "FROM merged v") for part in (PROFILE_SQL, RULES_SQL))
    return f"""WITH RECURSIVE {SELECTED}, {knn_sql(10)}, {dbscan_sql(eps)},
held AS (SELECT d.id, d.cid, v.f, v.y_true, count(*) OVER (PARTITION BY d.cid) >= 5 AS big FROM dense d JOIN vec v ON d.id = v.index),
close AS (SELECT a.id, b.cid, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS place
  FROM held a JOIN held b ON b.big WHERE NOT a.big QUALIFY place <= 5),
ballot AS (SELECT id, cid, count(*) AS c FROM close GROUP BY 1, 2),
moved AS (SELECT id, cid FROM ballot QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, cid) = 1),
merged AS (SELECT h.id AS index, h.y_true, h.f, CASE WHEN h.big THEN h.cid ELSE m.cid END AS given_cid
  FROM held h LEFT JOIN moved m USING (id) WHERE h.big OR m.cid IS NOT NULL),
{profiles}, {rules}"""


@query("pipe7_dbscan_instead_of_graph", f"""{dense_alarms_sql(ABLATION_EPS[0])},
one AS (SELECT * FROM alarm WHERE rule = 'combined_fwd'), {curve_sql('one')}
SELECT tau_6 AS tau, max(r_fpr) AS r_fpr, max(r_tpr) AS r_tpr FROM (
  SELECT round(tau, 6) + 0.0 AS tau_6, round(r_fpr, 6) + 0.0 AS r_fpr, round(r_tpr, 6) + 0.0 AS r_tpr FROM curve) GROUP BY 1""")
def pipe7(spark, sf):
    """The curve of one radius and rule over merged and profiled density clusters."""
    x = selected(spark, sf)
    cells = ex.cluster_cells(x, ex.dbscan_clusterings(x, ABLATION_EPS[:1], GRID), [5], ["combined_fwd"])
    curve = ev.threshold_curve(ex.cell_alarms(x, cells))
    return curve.groupBy(r6("tau").alias("tau")).agg(
        F.max(r6("r_fpr")).alias("r_fpr"), F.max(r6("r_tpr")).alias("r_tpr"))


@query("pipe7_dbscan_sweep", " UNION ALL ".join(
    f"SELECT * FROM ({dense_alarms_sql(e)}, {curve_sql('alarm', 'rule')} "
    f"SELECT {e}::DOUBLE AS eps, rule, round(auc, 6) + 0.0 AS auc FROM area)" for e in ABLATION_EPS))
def pipe7_sweep(spark, sf):
    """All radii and rules in one evaluation of merged and profiled density clusters."""
    x = selected(spark, sf)
    auc, cells = ex.sweep_auc(x, ex.dbscan_clusterings(x, ABLATION_EPS, GRID), [5], list(GRID.rules))
    radius = {i: cell["eps"] for i, cell in cells.index.items()}
    return auc.select(gr.per_key("cell", radius).alias("eps"), "rule", r6("auc").alias("auc"))


@query("pipe7_dbscan_variant")
def pipe7_full(spark, sf):
    """Radii from the distances to the fifth neighbour, since the default radii suit other scales."""
    data = prepared(spark, sf)
    got = ab.with_dbscan(data, GRID, ab.neighbour_radii(data.sweep))
    if got is None:
        return spark.createDataFrame([], "tau double, r_fpr double, r_tpr double, cer double, auc double, "
                                         "cell string, min_size int, rule string, blend double")
    return described(got)


@query("pipe8_kmeans_instead_of_graph")
def pipe8(spark, sf):
    return described(ab.with_kmeans(prepared(spark, sf), GRID))


@query("pipe9_fixed_rule")
def pipe9(spark, sf):
    d, c = swept(spark, sf)
    return described(ab.with_fixed_rule(d, GRID, c))


@query("pipe10_without_blend")
def pipe10(spark, sf):
    d, c = swept(spark, sf)
    return described(ab.without_blend(d, GRID, c))


@query("pipe11_ablation_runner")
def pipe11(spark, sf):
    """Every variant of an experiment; the full one takes its metrics from the result table of a batch run."""
    root, out = experiment_tree(spark, sf, (("vec", 16),)), scratch_path(spark, "ablation")
    prior = ba.run_batch(spark, root, scratch_path(spark, "batch"), GRID)
    rows = ba.run_ablation(spark, root, out, GRID, prior)
    return ba.summarise_ablation(rows).select("dataset", "model", "variant", "n_rows", r6("auc_mean").alias("auc_mean"))


@query("on1_online_batch")
def on1(spark, sf):
    d, got = finished(spark, sf)
    return filter_batch(ad.alarms(spark, sf), got[0], d.dims, GRID)


@query("on1_online_stream")
def on1_stream(spark, sf):
    """The alarms as a stream of files, filtered batch by batch with the frozen configuration."""
    d, got = finished(spark, sf)
    src, out = scratch_path(spark, "arrivals"), scratch_path(spark, "filtered")
    ad.alarms(spark, sf).select("index", "features").write.parquet(src)
    stream = spark.readStream.schema("index long, features array<double>").parquet(src)
    q = filter_stream(stream, got[0], d.dims, out, scratch_path(spark, "offsets"), GRID)
    q.awaitTermination()
    return spark.read.parquet(out).select("id", "cid", r6("score").alias("score"), "removed")


@query("on1_trailing_stream")
def on1_trailing(spark, sf):
    """Two batches of very uneven size, cut where the frozen share of all scores so far lies."""
    grid = replace(GRID, quantile_tau=True)
    d, c = swept(spark, sf)
    choice = ex.search(d.sweep, c, grid)
    frozen = ex.freeze(d.val, choice, grid, ex.chosen_cell(c, choice))
    src, out = scratch_path(spark, "arrivals"), scratch_path(spark, "filtered")
    rows = ad.alarms(spark, sf).select("index", "features")
    small = F.col("index") % 10 == 0
    for part in (rows.filter(~small), rows.filter(small)):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("index long, features array<double>").parquet(src)
    # the test side and the stream need the frozen configuration only, not each other
    list(side_by_side(spark, [
        lambda: ex.apply_frozen(d.test, frozen, grid),
        lambda: filter_stream(stream, frozen, d.dims, out, scratch_path(spark, "offsets"), grid, trailing=10).awaitTermination()]))
    return spark.read.parquet(out).select("id", "cid", r6("score").alias("score"), "removed")
