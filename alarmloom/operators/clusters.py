"""Micro-cluster merging, clustering alternatives and cluster profiles.

Point tables are (index, features); memberships are (run, id, cid). ``run`` numbers the cells of a
parameter grid, so one job serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import names, squared_distance, unroll, width
from ..runtime import add_up, durable, lookup_join, union_all
from .graph import connected_components
from .kmeans import kmeans_grid
from .neighbors import knn_join, kth_distance, range_join, vote

VOTERS = 5


def with_sizes(membership: DataFrame) -> DataFrame:
    """Add the size of the row's cluster; counts are combined before any row is moved."""
    sizes = membership.groupBy("run", "cid").agg(F.count("*").alias("size"))
    return lookup_join(membership, sizes, ["run", "cid"], ["id"])


def merge_micro_clusters(
    points: DataFrame, membership: DataFrame, min_sizes: list[int], knn: DataFrame | None = None,
) -> DataFrame:
    """(run, min_size, id, cid, merge_skipped) for every run and minimum size.

    Rows of clusters below the minimum take the majority label of their 5 nearest core rows. An
    existing neighbour list answers this exactly whenever it already holds 5 core rows (they are the
    nearest ones); only the remaining rows are joined again, against the core rows of their run.
    Without any core row the labels stay and ``merge_skipped`` is set.
    """
    pick = F.explode(F.array(*[F.lit(m) for m in min_sizes])).alias("min_size")
    sized = durable(
        with_sizes(membership).select("run", "id", "cid", "size", pick).withColumn(
            "core", F.col("size") >= F.col("min_size")), "sized")
    cells = sized.groupBy("run", "min_size").agg(
        F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("micros")).collect()
    open_ = {(r["run"], r["min_size"]) for r in cells if r["cores"] and r["micros"]}
    skipped = {(r["run"], r["min_size"]) for r in cells if not r["cores"]}
    kept = sized.filter("core").select("run", "min_size", "id", "cid", F.lit(False).alias("merge_skipped"))
    same = sized.filter(~F.col("core")).select("run", "min_size", "id", "cid")
    parts = [kept]
    if skipped:
        parts.append(_cells(same, skipped).withColumn("merge_skipped", F.lit(True)))
    if open_:
        micro = _cells(same, open_)
        core = _cells(sized.filter("core"), open_).select("run", "min_size", "id", "cid")
        parts.append(_reassign(points, micro, core, knn, sorted(open_)))
    return durable(union_all(parts), "merged")


def _cells(df: DataFrame, cells: set) -> DataFrame:
    """Rows of the listed (run, min_size) grid cells."""
    test = F.lit(False)
    for run, m in sorted(cells):
        test = test | ((F.col("run") == run) & (F.col("min_size") == m))
    return df.filter(test)


def _reassign(points, micro, core, knn, cells) -> DataFrame:
    listed = sorted(cells)
    grp = F.lit(None).cast("long")
    for i, (run, m) in enumerate(listed):
        grp = F.when((F.col("run") == run) & (F.col("min_size") == m), F.lit(i).cast("long")).otherwise(grp)
    label = core.select("run", "min_size", F.col("id").alias("dst"), F.col("cid").alias("_label"))
    done = None
    left = micro
    if knn is not None:
        near = micro.select("run", "min_size", F.col("id").alias("src")).join(
            knn.select("src", "dst", "d", "rank"), "src")
        known = lookup_join(near, label, ["run", "min_size", "dst"], ["src"])
        # at most k entries per row, so the list stays small
        lists = durable(known.groupBy("run", "min_size", "src").agg(
            F.slice(F.sort_array(F.collect_list(F.struct("rank", "_label"))), 1, VOTERS)
            .alias("near")).filter(F.size("near") == VOTERS), "voters")
        done = lists.select("run", "min_size", "src", F.explode("near").alias("x")).select(
            grp.alias("grp"), "src", "x._label")
        left = micro.join(lists.select("run", "min_size", F.col("src").alias("id")),
                          ["run", "min_size", "id"], "left_anti")
    left = durable(left, "left")
    open_groups = [r["g"] for r in left.select(grp.alias("g")).distinct().collect()]
    ballots = [done] if done is not None else []
    if open_groups:
        vec = points.select(F.col("index").alias("id"), "features")
        q = left.join(vec, "id").select(grp.alias("grp"), F.col("id").alias("index"), "features")
        r = core.filter(grp.isin(open_groups)).join(vec, "id").select(
            grp.alias("grp"), F.col("id").alias("index"), "features", F.col("cid").alias("_label"))
        near = knn_join(q, r, VOTERS, by="grp")
        tags = r.select("grp", F.col("index").alias("dst"), "_label")
        ballots.append(lookup_join(near, tags, ["grp", "dst"], ["src"]).select(
            "grp", "src", "_label"))
    won = vote(union_all(ballots))
    back = F.array(*[F.struct(F.lit(run).cast("long").alias("run"), F.lit(m).cast("int").alias("min_size")) for run, m in listed])
    return won.withColumn("_c", F.get(back, F.col("grp").cast("int"))).select(
        "_c.run", "_c.min_size",
        F.col("src").alias("id"), F.col("_label").alias("cid"), F.lit(False).alias("merge_skipped"))


# --- profiles -------------------------------------------------------------------------------------

def cluster_profiles(
    points: DataFrame, membership: DataFrame, kdist: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """One row per (by, cid): size, distances to the global and anchor centres, spread, density.

    The anchor is the largest cluster (lowest id on a tie). Centroids are partial aggregates; the
    second pass looks them up per row and aggregates again. ``kdist`` is (id, kdist) or carries
    keys of ``by`` too.
    """
    by = by or ["run"]
    dims = width(points)
    f = names(dims)
    x = unroll(points.select(F.col("index").alias("id"), "features"), dims)
    rows = membership.select(*by, "id", "cid").join(x, "id")
    if kdist is not None:
        shared = [c for c in by if c in kdist.columns] + ["id"]
        rows = rows.join(kdist.select(*shared, "kdist"), shared, "left")
    else:
        rows = rows.withColumn("kdist", F.lit(None).cast("double"))
    rows = durable(rows, "profile")
    sums = durable(rows.groupBy(*by, "cid").agg(
        F.count("*").alias("size"), F.avg("kdist").alias("avg_kdist"),
        *[F.expr(f"sum({c}) AS s_{c}") for c in f]), "centroids")
    centre = [f"(s_{c} / size)" for c in f]
    anchor = ", ".join(f"'a_{c}', {e}" for e, c in zip(centre, f))
    whole = sums.groupBy(*by).agg(
        *[F.expr(f"sum(s_{c}) / sum(size) AS g_{c}") for c in f],
        F.expr(f"max_by(named_struct({anchor}), named_struct('n', size, 'c', -cid)) AS anchor"))
    spread = lookup_join(
        rows.select(*by, "id", "cid", *f),
        sums.selectExpr(*by, "cid", *[f"{e} AS c_{c}" for e, c in zip(centre, f)]),
        [*by, "cid"], ["id"],
    ).select(*by, "cid", F.sqrt(squared_distance(f, [f"c_{c}" for c in f])).alias("d")).groupBy(
        *by, "cid").agg(F.avg("d").alias("avg_intra_dist"), F.max("d").alias("max_radius"))
    to_global = F.sqrt(squared_distance(centre, [f"g_{c}" for c in f]))
    to_anchor = F.sqrt(squared_distance(centre, [f"anchor.a_{c}" for c in f]))
    density = F.col("size") / (F.col("avg_intra_dist") + F.lit(1e-6))
    return sums.join(F.broadcast(whole), by).join(spread, [*by, "cid"]).select(
        *by, "cid", "size", F.log1p(F.col("size").cast("double")).alias("log_size"),
        to_global.alias("dist_to_global"), to_anchor.alias("dist_to_anchor"),
        "avg_intra_dist", "max_radius", density.alias("density_score"),
        (density / F.col("size")).alias("density_size"), F.log1p(density).alias("log_density"),
        "avg_kdist",
    )


# --- alternatives to the graph ----------------------------------------------------------------------

def kmeans(points: DataFrame, clusters: int, seed: int = 42, tries: int = 10) -> DataFrame:
    """(id, cid): best of ``tries`` seeded fits by training cost, min(clusters, n - 1) clusters."""
    return kmeans_grid(points, [clusters], seed, tries).select("id", "cid")


def dbscan(points: DataFrame, eps: float, min_samples: int = 5, **blocks) -> DataFrame:
    """(id, cid, kind): density clusters named by their lowest core id; kind core, border or noise.

    Neighbour counts, a spanning forest per block pair and its connected components replace the
    quadratic list of pairs. Border rows join the lowest adjacent core cluster. Each noise row is a
    cluster of its own, named by -1 - id, so that micro-cluster merging can reassign it.
    """
    pts = points.select("index", "features")
    n = durable(range_join(pts, eps, "count", **blocks), "count")
    core_ids = n.filter(F.col("n") >= min_samples).select(F.col("src").alias("index"))
    cores = durable(pts.join(core_ids, "index"), "core")
    loose = durable(pts.join(core_ids, "index", "left_anti"), "loose")
    ids = cores.select(F.lit(0).cast("long").alias("graph"), F.col("index").alias("id"))
    links = range_join(cores, eps, "forest", **blocks).select(
        F.lit(0).cast("long").alias("graph"), "src", "dst")
    comp = durable(connected_components(links, ids), "comp").select("id", F.col("comp").alias("cid"))
    parts = [comp.select("id", "cid", F.lit("core").alias("kind"))]
    # border: lowest cluster among the core rows within eps; a loose row has fewer than min_samples
    # neighbours, so these pairs are at most min_samples per row
    reach = range_join(loose, eps, "pairs", others=cores, **blocks)
    border = lookup_join(reach.select("src", "dst"), comp.withColumnRenamed("id", "dst"),
                         ["dst"], ["src"]).groupBy("src").agg(F.min("cid").alias("cid"))
    rest = loose.select(F.col("index").alias("id")).join(
        border.withColumnRenamed("src", "id"), "id", "left")
    parts.append(rest.select(
        "id", F.coalesce("cid", F.lit(-1) - F.col("id")).alias("cid"),
        F.when(F.col("cid").isNull(), "noise").otherwise("border").alias("kind")))
    return union_all(parts)


def neighbour_scale(points: DataFrame, k: int = 10) -> DataFrame:
    """(id, kdist): distance to the k-th other row."""
    return kth_distance(knn_join(points, None, k, exclude_self=True)).select(
        F.col("src").alias("id"), "kdist")


def total_spread(points: DataFrame, membership: DataFrame) -> DataFrame:
    """Within-cluster sum of squares of a partition (id, cid)."""
    dims = width(points)
    f = names(dims)
    rows = unroll(points.select(F.col("index").alias("id"), "features"), dims).join(membership, "id")
    per = rows.groupBy("cid").agg(*[F.var_pop(c).alias(c) for c in f], F.count("*").alias("n"))
    return per.agg(F.sum(F.col("n") * add_up([F.col(c) for c in f])).alias("cost"))
