"""Model selection on a validation split, frozen application to the test split, baselines.

A parameter grid is a set of rows: one neighbour join at the largest k, one community job for all
(k, resolution) cells, and rules, minimum sizes and blends as columns of one evaluation.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines as bl
from ..operators import clusters as cl
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import graph as gr
from ..operators import neighbors as nb
from ..operators import sampling as sa
from ..operators import scoring as sc
from ..operators.density import dbscan_sweep
from ..operators.kmeans import kmeans_grid
from ..functions.vectors import width
from ..runtime import durable, local_rows

# Blend weights, DBSCAN radii and KMeans sizes of the search.
BLENDS = [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0]
DBSCAN_EPS = [0.1, 0.3, 0.5, 1.0]
KMEANS_SIZES = [10, 20, 50, 100]


@dataclass(frozen=True)
class Grid:
    """Search space with the published defaults.

    ``sweep_cap`` and ``baseline_cap`` draw a sample of the validation rows for model selection and for
    the baselines; by default both see every row.
    """

    ks: tuple[int, ...] = (10, 30)
    resolutions: tuple[float, ...] = (0.5, 1.0, 10.0)
    min_sizes: tuple[int, ...] = (5, 10)
    rules: tuple[str, ...] = tuple(sc.RULES)
    blends: tuple[float, ...] = tuple(BLENDS)
    top_features: int = 20
    val_ratio: float = 0.3
    seed: int = 42
    cluster_seed: int = 42
    feature_selection: bool = True
    quantile_tau: bool = False
    dense_fallback: float | None = None
    sweep_cap: int | None = None
    baseline_cap: int | None = None


@dataclass(frozen=True)
class Choice:
    """A frozen configuration: how to cluster, how to score, where to cut."""

    cell: dict
    min_size: int
    rule: str
    blend: float = 0.0
    val_auc: float = -1.0
    tau: float | None = None
    val_point: dict = field(default_factory=dict)


@dataclass
class Prepared:
    """Transformed sides of one alarm set; *_full keep every feature for the baselines."""

    val: DataFrame
    test: DataFrame
    sweep: DataFrame
    val_full: DataFrame
    test_full: DataFrame
    dims: list[int]


def prepare(alarms: DataFrame, grid: Grid = Grid()) -> Prepared | None:
    """Split, scale each side on itself, select features on the validation side.

    Each side is written once with all features; selections and samples are projections of it.
    """
    cut = sa.validation_test_split(alarms.select("index", "features", "y_true"), grid.val_ratio, grid.seed)
    if cut is None:
        return None
    cut = durable(cut, "cut")
    sides = {s: durable(fe.minmax_log(cut.filter(F.col("side") == s).drop("side")), s)
             for s in ("val", "test")}
    if grid.feature_selection:
        dims = fe.top_variance_dims(sides["val"], grid.top_features)
    else:
        dims = list(range(width(sides["val"])))
    val, test = (fe.keep_dims(sides[s], dims) for s in ("val", "test"))
    sweep = sa.capped_subsample(val, grid.sweep_cap, "index", grid.seed) if grid.sweep_cap else val
    return Prepared(val, test, sweep, sides["val"], sides["test"], dims)


# --- clusterings ---------------------------------------------------------------------------------------
#
# A clustering of a point set is (membership (run, id, cid), kdist (run, id, kdist), neighbour list).

@dataclass
class Clustering:
    membership: DataFrame
    kdist: DataFrame
    knn: DataFrame | None
    cells: dict


def _vertices(points: DataFrame, ks) -> DataFrame:
    graphs = F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))
    return points.select(graphs.alias("graph"), F.col("index").alias("id"))


def _kdist_rows(knn: DataFrame, per_run: dict, spark) -> DataFrame:
    runs = local_rows(spark, [(r, k) for r, k in per_run.items()], "run long, k int")
    per = knn.groupBy("src").agg(*[
        F.max(F.when(F.col("rank") <= k, F.col("d"))).alias(f"k{k}") for k in sorted(set(per_run.values()))])
    value = F.coalesce(*[F.when(F.col("k") == k, F.col(f"k{k}")) for k in sorted(set(per_run.values()))])
    ks = F.explode(F.array(*[F.lit(k) for k in sorted(set(per_run.values()))]))
    return per.select(F.col("src").alias("id"), *[c for c in per.columns if c != "src"],
                      ks.alias("k")).join(F.broadcast(runs), "k").select(
        "run", "id", value.alias("kdist"))


def graph_clusterings(
    points: DataFrame, ks: list[int], resolutions: list[float], grid: Grid, sweep: bool = True
) -> Clustering:
    """All (k, resolution) cells from one neighbour join and one community job.

    In a sweep, dense graphs skip resolutions of 10 and more; a final run falls back instead.
    """
    spark = points.sparkSession
    knn = durable(nb.knn_join(points, None, max(ks), exclude_self=True), "knn")
    edges = durable(gr.knn_graph(knn, ks), "graph")
    vertices = _vertices(points, ks)
    dense = gr.dense_graphs(edges, vertices)
    cells: dict[int, dict] = {}
    for k in ks:
        listed = gr.usable_resolutions(resolutions, k in dense) if sweep else [
            gr.fallback_resolution(r, k in dense, list(grid.resolutions), grid.dense_fallback)
            for r in resolutions]
        for r in listed:
            cells[len(cells)] = {"k": k, "res": r}
    runs = [(i, c["k"], c["res"]) for i, c in cells.items()]
    membership = gr.communities(edges, vertices, runs, grid.cluster_seed)
    kdist = durable(_kdist_rows(knn, {i: c["k"] for i, c in cells.items()}, spark), "kdist")
    return Clustering(membership, kdist, knn, cells)


def _flat_clustering(points: DataFrame, cells: dict, member: DataFrame) -> Clustering:
    """``member`` is (run, id, cid), where a run is the number of its cell."""
    knn = durable(nb.knn_join(points, None, 10, exclude_self=True), "knn")
    kdist = durable(_kdist_rows(knn, {i: 10 for i in cells}, points.sparkSession), "kdist")
    return Clustering(durable(member.select("run", "id", "cid"), "flat"), kdist, knn, cells)


def dbscan_clusterings(points: DataFrame, eps: list[float], grid: Grid, sweep: bool = True) -> Clustering:
    """All radii are cuts of one density forest; a single radius needs none."""
    if len(eps) == 1:
        member = cl.dbscan(points, eps[0]).withColumn("run", F.lit(0).cast("long"))
    else:
        member = dbscan_sweep(points, eps)
    return _flat_clustering(points, {i: {"eps": e} for i, e in enumerate(eps)}, member)


def kmeans_clusterings(points: DataFrame, sizes: list[int], grid: Grid, sweep: bool = True) -> Clustering:
    """All cluster counts from one job a round."""
    cells = {i: {"nc": n} for i, n in enumerate(sizes)}
    fitted = kmeans_grid(points, sizes, grid.cluster_seed)
    runs = local_rows(points.sparkSession, list(enumerate(sizes)), "run long, clusters long")
    return _flat_clustering(points, cells, fitted.join(F.broadcast(runs), "clusters"))


# --- phase 1 and 2 ---------------------------------------------------------------------------------------

@dataclass
class Cells:
    """Merged clusterings of a grid: members (cell, run, id, cid), cluster scores (cell, cid, size, rule, score)
    and what every cell number stands for."""

    member: DataFrame
    scored: DataFrame
    index: dict


def cluster_cells(
    points: DataFrame, c: Clustering, min_sizes: list[int], rules: list[str], min_clusters: int = 1
) -> Cells:
    """Every (run, min_size) cell merged, profiled and scored by every rule, at the level of clusters.

    ``cell`` numbers (run, min_size) in loop order. Cells without a core row, or with fewer than
    ``min_clusters`` clusters, are left out.
    """
    merged = cl.merge_micro_clusters(points, c.membership, min_sizes, c.knn)
    listed = {(run, m): i for i, (run, m) in enumerate(
        (run, m) for run in sorted(c.cells) for m in min_sizes)}
    number = F.lit(None).cast("long")
    for (run, m), i in listed.items():
        number = F.when((F.col("run") == run) & (F.col("min_size") == m), F.lit(i).cast("long")).otherwise(number)
    cells = merged.filter(~F.col("merge_skipped")).withColumn("cell", number)
    if min_clusters > 1:
        # a clustering with too few clusters is skipped before and after merging
        before = c.membership.groupBy("run").agg(F.countDistinct("cid").alias("n"))
        after = cells.groupBy("run", "cell").agg(F.countDistinct("cid").alias("m"))
        good = [r["cell"] for r in after.join(before, "run").filter(
            (F.col("n") >= min_clusters) & (F.col("m") >= min_clusters)).collect()]
        cells = cells.filter(F.col("cell").isin(good))
    member = durable(cells.select("cell", "run", "id", "cid"), "cells")
    of_run = F.broadcast(member.select("cell", "run").distinct())  # a row per cell of the grid
    kdist = c.kdist.join(of_run, "run").select("cell", "id", "kdist")
    profiles = durable(cl.cluster_profiles(points, member, kdist, by=["cell"]), "profiles")
    scored = durable(sc.score_clusters(profiles, rules, by=["cell"]), "scores")
    return Cells(member, scored, {i: {**c.cells[run], "_run": run, "min_size": m} for (run, m), i in listed.items()})


def cell_alarms(points: DataFrame, cells: Cells, cell: int | None = None, rule: str | None = None) -> DataFrame:
    """(cell, rule, id, cid, score, y_true) of one cell and rule, or of those that ``cells`` holds."""
    keep = F.lit(True) if cell is None else F.col("cell") == cell
    want = F.lit(True) if rule is None else F.col("rule") == rule
    y = points.select(F.col("index").alias("id"), "y_true")
    rows = sc.alarm_scores(cells.member.filter(keep), cells.scored.filter(keep & want), by=["cell"])
    return rows.join(y, "id")


def sweep_auc(
    points: DataFrame, c: Clustering, min_sizes: list[int], rules: list[str], min_clusters: int = 1
) -> tuple[DataFrame, Cells]:
    """(cell, rule, auc) of the whole grid in one evaluation.

    A rule gives all alarms of a cluster one score, so the curves come from the label counts of the clusters:
    no row of alarm, cell and rule is ever made.
    """
    cells = cluster_cells(points, c, min_sizes, rules, min_clusters)
    y = points.select(F.col("index").alias("id"), "y_true")
    labels = cells.member.join(y, "id").groupBy("cell", "cid").agg(
        F.count("*").alias("n"), F.count_if(F.col("y_true") == 0).alias("fp"), F.count_if(F.col("y_true") == 1).alias("tp"))
    ruled = cells.scored.select("cell", "cid", "rule", sc.effective_score().alias("tau")).join(labels, ["cell", "cid"])
    curve = ev.counted_curve(ruled.groupBy("cell", "rule", "tau").agg(
        F.sum("n").alias("n_here"), F.sum("fp").alias("fp_here"), F.sum("tp").alias("tp_here")), ["cell", "rule"])
    return durable(ev.curve_auc(curve, ["cell", "rule"]), "auc"), cells


def _best(auc: DataFrame, rules: list[str]) -> tuple[int, str, float] | None:
    """Highest AUC; the first cell, then the first rule in loop order wins ties."""
    place = F.array_position(F.array(*[F.lit(r) for r in rules]), F.col("rule"))
    b = auc.filter(F.col("auc").isNotNull()).agg(F.max_by(
        F.struct("cell", "rule", "auc"), F.struct(F.round("auc", 12), -F.col("cell"), -place)
    ).alias("b")).head()["b"]
    return (b["cell"], b["rule"], b["auc"]) if b else None


def search(
    points: DataFrame, c: Clustering, grid: Grid, min_clusters: int = 1, blend: bool = True
) -> Choice | None:
    """Phase 1 over the grid, phase 2 over the blends of its winner (strict improvement)."""
    rules = list(grid.rules)
    auc, cells = sweep_auc(points, c, list(grid.min_sizes), rules, min_clusters)
    best = _best(auc, rules)
    if best is None:
        return None
    cell, rule, value = best
    where = cells.index[cell]
    choice = Choice({k: v for k, v in where.items() if k not in ("_run", "min_size")},
                    where["min_size"], rule, 0.0, value)
    if not blend or not grid.blends:
        return choice
    won = durable(cell_alarms(points, cells, cell, rule), "won")
    mixed = sc.blended(won.select("id", "cid", "y_true", "score"), c.kdist.filter(
        F.col("run") == where["_run"]).select("id", "kdist"), list(grid.blends), by=[])
    areas = {r["blend"]: r["auc"] for r in ev.curve_auc(
        ev.threshold_curve(mixed, ["blend"]), ["blend"]).collect()}
    for b in grid.blends:
        if areas.get(b) is not None and areas[b] > choice.val_auc + 1e-12:
            choice = replace(choice, blend=b, val_auc=areas[b])
    return choice


# --- phase 3 ------------------------------------------------------------------------------------------------

def cluster_once(points: DataFrame, choice: Choice, grid: Grid) -> Clustering:
    if "eps" in choice.cell:
        return dbscan_clusterings(points, [choice.cell["eps"]], grid, False)
    if "nc" in choice.cell:
        return kmeans_clusterings(points, [choice.cell["nc"]], grid, False)
    return graph_clusterings(points, [choice.cell["k"]], [choice.cell["res"]], grid, False)


def score_alarms(
    points: DataFrame, choice: Choice, grid: Grid, known: Clustering | None = None
) -> DataFrame:
    """(id, cid, y_true, score) of a batch under a frozen configuration; labels are not used.

    ``known`` is a clustering of the same points that already holds the chosen cell.
    """
    c = known or cluster_once(points, choice, grid)
    rows = cell_alarms(points, cluster_cells(points, c, [choice.min_size], [choice.rule]))
    flat = durable(rows.select("id", "cid", "y_true", "score"), "scored")
    return durable(sc.blended(flat, c.kdist.select("id", "kdist"), [choice.blend], by=[]).drop("blend"), "alarms")


def chosen_cell(c: Clustering, choice: Choice) -> Clustering | None:
    """The part of a sweep that belongs to the chosen cell."""
    run = next((i for i, cell in c.cells.items() if cell == choice.cell), None)
    if run is None:
        return None
    only = F.col("run") == run
    return Clustering(c.membership.filter(only), c.kdist.filter(only), c.knn, {run: choice.cell})


def freeze(
    points: DataFrame, choice: Choice, grid: Grid, known: Clustering | None = None
) -> Choice:
    """Choose the threshold on the full validation side."""
    p = ev.evaluate_scores(
        score_alarms(points, choice, grid, known), quantile_tau=grid.quantile_tau).head()
    if p is None:
        return choice
    return replace(choice, tau=p["tau"], val_point={
        "r_fpr": p["r_fpr"], "r_tpr": p["r_tpr"], "CER": p["CER"]})


def apply_frozen(points: DataFrame, choice: Choice, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(alarms with ``removed``, metrics) of the test side at the frozen threshold."""
    rows = score_alarms(points, choice, grid)
    tau = choice.tau
    if grid.quantile_tau and tau is not None:
        tau = ev.transfer_quantile(rows, tau).head()["tau"]
    metrics = ev.evaluate_scores(rows, tau=tau)
    cut = metrics.head()
    removed = rows.withColumn("removed", F.col("score") >= F.lit(cut["tau"] if cut else tau))
    return removed, metrics


def finalize(
    data: Prepared, choice: Choice | None, grid: Grid, sweep: Clustering | None = None
) -> tuple[Choice, DataFrame] | None:
    """Threshold on the full validation side, metrics on the test side.

    When the sweep already covered the whole validation side its clustering is reused as it is.
    """
    if choice is None:
        return None
    known = chosen_cell(sweep, choice) if sweep is not None and data.sweep is data.val else None
    frozen = freeze(data.val, choice, grid, known)
    return frozen, apply_frozen(data.test, frozen, grid)[1]


def run_filter(
    data: Prepared, grid: Grid = Grid(), sweep: Clustering | None = None
) -> tuple[Choice, DataFrame] | None:
    """The full method on prepared data: sweep, blend, threshold, test metrics."""
    c = sweep or graph_clusterings(data.sweep, list(grid.ks), list(grid.resolutions), grid)
    return finalize(data, search(data.sweep, c, grid), grid, c)


# --- baselines --------------------------------------------------------------------------------------------------

def tune_baseline(
    score, values: list, refs: DataFrame, test: DataFrame
) -> tuple[object, DataFrame | None]:
    """Best value of one parameter by AUC on the reference rows, threshold there, metrics on test.

    ``score(refs, queries, values)`` returns (param, id, score) rows, ``queries=None`` meaning the
    reference rows themselves; param is the position in ``values``.
    """
    y_ref = refs.select(F.col("index").alias("id"), "y_true")
    own = score(refs, None, values)
    best = len(values) // 2
    if own is None:
        return values[best], None
    own = durable(own.join(y_ref, "id"), "own")
    points = {r["param"]: r for r in ev.evaluate_scores(own, ["param"]).collect()}
    top = -1.0
    for i in range(len(values)):
        if i in points and points[i]["auc"] > top + 1e-12:
            top, best = points[i]["auc"], i
    tau = points[best]["tau"] if best in points else None
    got = score(refs, test, [values[best]])
    if got is None:
        return values[best], None
    y_test = test.select(F.col("index").alias("id"), "y_true")
    rows = durable(got.select("id", "score").join(y_test, "id"), "other")
    if rows.isEmpty():
        return values[best], None
    return values[best], ev.evaluate_scores(rows, tau=tau)


def _positions(df: DataFrame, values: list) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(int(v)) for v in values]), F.col("k")) - 1
    return df.select(place.cast("int").alias("param"), "id", "score")


def _knn_baseline(n):
    return lambda refs, q, ks: _positions(bl.knn_distance_scores(refs, q, ks, n), ks)


def _lof_baseline(n):
    return lambda refs, q, ks: _positions(bl.lof_scores(refs, q, ks, n), ks)


def _forest_baseline(refs, q, values):
    """Contamination has no effect on the scores, so the first value wins; computed once."""
    got = bl.isolation_scores(refs, refs if q is None else q)
    return None if got is None else got.select(F.lit(0).alias("param"), "id", "score")


def run_baselines(data: Prepared, grid: Grid = Grid()) -> dict:
    """{name: (parameter, metrics)} for the three baselines on all transformed features."""
    refs = data.val_full
    if grid.baseline_cap:
        refs = durable(sa.capped_subsample(refs, grid.baseline_cap, "index", grid.seed), "refs")
    n = refs.count()
    return {
        "if": tune_baseline(_forest_baseline, [0.01, 0.05, "auto", 0.1, 0.3], refs, data.test_full),
        "lof": tune_baseline(_lof_baseline(n), [10, 20, 30], refs, data.test_full),
        "knn": tune_baseline(_knn_baseline(n), [5, 10, 20], refs, data.test_full),
    }


# --- one experiment ------------------------------------------------------------------------------------------------

def run_experiment(alarms: DataFrame, grid: Grid = Grid(), baselines: bool = True) -> dict | None:
    """One flat result row; None when a class has fewer than 10 alarms."""
    data = prepare(alarms, grid)
    if data is None:
        return None
    n = data.test.agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == 0).alias("fp"),
                      F.count_if(F.col("y_true") == 1).alias("tp")).head()
    row = {"n_test": n["n"], "fp_test": n["fp"], "tp_test": n["tp"], "n_features": len(data.dims)}

    def put(prefix, metrics):
        m = metrics.head() if metrics is not None else None
        for name, col in (("R.FPR", "r_fpr"), ("R.TPR", "r_tpr"), ("CER", "CER"), ("auc", "auc")):
            row[f"{prefix}_{name}"] = m[col] if m else None

    got = run_filter(data, grid)
    put("filter", got[1] if got else None)
    c = got[0] if got else Choice({}, 0, "")
    row.update({
        "filter_k": c.cell.get("k"), "filter_res": c.cell.get("res"), "filter_ms": c.min_size if got else None,
        "filter_scoring": c.rule if got else None, "filter_blend": c.blend if got else None,
        "filter_tau": c.tau, "filter_val_auc": c.val_auc if got else None,
        "filter_val_R.FPR": c.val_point.get("r_fpr"), "filter_val_R.TPR": c.val_point.get("r_tpr")})
    if baselines:
        for name, (param, metrics) in run_baselines(data, grid).items():
            put(name, metrics)
            row[f"{name}_param"] = str(param)
    return row
