"""One density hierarchy for every radius of a sweep.

The core distance of a vector is the distance to its ``min_samples``-th row, itself and its copies
included; the reach of a pair is the largest of its distance and both core distances. Two core rows of
a radius share a density cluster exactly if edges of at most that reach connect them, so a minimum
spanning forest by reach holds the clusters of all radii at once.

The forest grows in Boruvka rounds: every component takes its shortest edge out. Neighbour lists give
most of these edges. A vector is searched for again only while an edge that its list does not hold
could be shorter than the best one known to its component; it then visits the cells within that
bound, without those that lie wholly in its own component. Equal edges may close a circle, which
changes no cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable, lookup_join, union_all
from . import neighbors as nb
from .graph import connected_components

_NEVER = float("inf")


@dataclass
class DensityForest:
    """rows (id, uid), core (uid, core), near (src, dst, d) and edges (src, dst, w) up to ``reach``.

    uid is the lowest id among the copies of a vector; core is null where there are fewer than
    ``min_samples`` rows at all.
    """

    rows: DataFrame
    core: DataFrame
    near: DataFrame
    edges: DataFrame
    reach: float


# --- numpy kernels --------------------------------------------------------------------------------

def _outgoing_kernel(dims: int):
    """Per query of a block pair: the shortest reach to a vector of another component, within its bound."""
    def run(batches):
        for b in batches:
            lists = [nb._lists(b.column(n)) for n in (
                "q_ids", "q_core", "q_comp", "q_bound", "r_ids", "r_core", "r_comp")]
            for q, r, qid, qk, qc, bound, rid, rk, rc in zip(
                    nb._matrix(b.column("q_vecs"), dims), nb._matrix(b.column("r_vecs"), dims), *lists):
                for t in nb._tiles(q, r):
                    got = _outgoing(q[t], qid[t], qk[t], qc[t], bound[t], r, rid, rk, rc)
                    if got is not None:
                        yield nb._found(0, *got)
    return run


def _outgoing(q, qid, qk, qc, bound, r, rid, rk, rc):
    same = qc[:, None] == rc[None, :]
    if same.all():
        return None
    w = np.maximum(nb._squared(q, r), np.maximum((qk * qk)[:, None], (rk * rk)[None, :]))
    w[same] = np.inf
    slack = 2.0 * nb._tolerance(q, r)
    low = w.min(1)
    cut = np.where(low <= bound * bound + slack, low + slack, -1.0)
    qi, ri = np.nonzero(w <= cut[:, None])
    d = np.maximum(nb._exact(q, r, qi, ri), np.maximum(qk[qi], rk[ri]))
    order = np.lexsort((rid[ri], d, qi))
    qi, ri, d = qi[order], ri[order], d[order]
    keep = (np.diff(qi, prepend=-1) > 0) & (d <= bound[qi])
    return qid[qi[keep]], rid[ri[keep]], d[keep]


_ASKED = ("grp", "uid", "vec", "core", "comp", "bound")


def _outward_kernel(pivots: np.ndarray, radius: np.ndarray, only: dict):
    """Cells within the bound of a query; ``only`` names the component of cells that hold a single one."""
    pure = np.array([c in only for c in range(len(pivots))])
    owner = np.array([only.get(c, 0) for c in range(len(pivots))], dtype=np.int64)

    def run(batches):
        for b in nb._pieces(batches):
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
            bound = b.column("bound").to_numpy(zero_copy_only=False)[:, None] + 1e-6
            comp = b.column("comp").to_numpy(zero_copy_only=False)[:, None]
            away = np.sqrt(nb._squared(x, pivots)) - radius[None, :]
            rows, cells = np.nonzero((away <= bound) & ~(pure[None, :] & (owner[None, :] == comp)))
            yield from nb._visited(b, _ASKED, rows, cells)
    return run


# --- the forest -----------------------------------------------------------------------------------

def _placed(cores: DataFrame, n: int, rows_per_cell: int):
    """(cores with a cell, pivots, radii, rows per cell); one cell and no pivots for few vectors."""
    cells = min(nb.MAX_CELLS, -(-n // rows_per_cell))
    if cells <= 1:
        return cores.withColumn("cell", F.lit(0)), None, None, {(0, 0): n}
    drawn = cores.select("vec").orderBy(F.xxhash64("vec")).limit(cells).collect()
    pivots = np.array([r["vec"] for r in drawn])
    placed = durable(cores.mapInArrow(
        nb._cell_kernel(pivots), "grp long, uid long, vec array<double>, core double, cell int, pd double"),
        "cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("pd").alias("r")).collect()
    radius = np.full(len(pivots), -np.inf)  # a cell without rows is never visited
    for s in stats:
        radius[s["cell"]] = s["r"] * (1 + nb._SLACK)
    return placed.drop("pd"), pivots, radius, {(0, s["cell"]): s["n"] for s in stats}


def _labelled(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Edges (src, dst, w) between two components, with these as ca and cb."""
    a = state.select(F.col("uid").alias("src"), F.col("comp").alias("ca"))
    b = state.select(F.col("uid").alias("dst"), F.col("comp").alias("cb"))
    both = lookup_join(lookup_join(edges, a, ["src"], ["dst"]), b, ["dst"], ["src"])
    return both.filter(F.col("ca") != F.col("cb")).select("src", "dst", "w", "ca", "cb")


def _shortest(out: DataFrame) -> DataFrame:
    """(comp, best): the shortest edge of every component, seen from both its ends."""
    ends = F.explode(F.array("ca", "cb")).alias("comp")
    return out.select(ends, F.struct("w", "src", "dst", "ca", "cb").alias("e")).groupBy("comp").agg(
        F.min("e").alias("best"))


def _joined(best: DataFrame) -> DataFrame:
    """(comp, _to): components that their shortest edges connect get one name.

    Every component points to the other end of its edge, so following the pointers ends in a circle. Pointers double
    in each step; ``low`` is the least component passed so far. The least one passed from the pointer
    on names the whole tree as soon as it is the same at both ends of every first pointer.
    """
    b = F.col("best")
    t = durable(best.select("comp", F.when(b["ca"] == F.col("comp"), b["cb"]).otherwise(b["ca"]).alias("to"))
                .select("comp", "to", F.col("to").alias("far"), F.col("comp").alias("low")), "pointers")
    while True:
        ahead = t.select(F.col("comp").alias("far"), F.col("far").alias("_far"), F.col("low").alias("_low"))
        t = durable(lookup_join(t, ahead, ["far"], ["comp"]).select(
            "comp", "to", F.col("_far").alias("far"), F.least("low", "_low").alias("low"),
            F.col("_low").alias("name")), "pointers")
        other = t.select(F.col("comp").alias("to"), F.col("name").alias("_name"))
        if lookup_join(t.select("comp", "to", "name"), other, ["to"], ["comp"]).filter(
                F.col("name") != F.col("_name")).isEmpty():
            return t.select("comp", F.col("name").alias("_to"))


def density_forest(
    points: DataFrame, reach: float, min_samples: int = 5, rows_per_cell: int = nb.ROWS_PER_CELL,
    block_rows: int | None = None,
) -> DensityForest:
    """Spanning forest of all pairs of reach at most ``reach`` with the least edges for every radius.

    ``points`` is (index, features). An empty table gives an empty forest; copies are one vertex.
    """
    spark = points.sparkSession
    d = nb.Distinct(points.select(
        F.lit(0).cast("long").alias("grp"), F.col("index").alias("id"), F.col("features").alias("vec")), 1)
    none = spark.createDataFrame([], "src long, dst long, w double")
    if d.rows == 0:
        return DensityForest(
            spark.createDataFrame([], "id long, uid long"), spark.createDataFrame([], "uid long, core double"),
            none.withColumnRenamed("w", "d"), none, reach)
    k = 2 * min_samples
    near = durable(nb._distinct_neighbours(d, d, k, rows_per_cell, block_rows).select(
        "src", "dst", "d", "rank"), "near")
    so_far = Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    listed = lookup_join(near, d.table.select(F.col("uid").alias("dst"), "mult"), ["dst"], ["src"])
    # a list of fewer than k vectors holds all there are
    core = durable(listed.withColumn("held", F.sum("mult").over(so_far)).groupBy("src").agg(
        F.min(F.when(F.col("held") >= min_samples, F.col("d"))).alias("core"),
        F.when(F.count("*") < k, F.lit(_NEVER)).otherwise(F.max("d")).alias("low")
    ).withColumnRenamed("src", "uid"), "core")
    forest = DensityForest(d.members().select("id", "uid"), core.select("uid", "core"),
                           near.select("src", "dst", "d"), none, reach)
    inside = core.filter(F.col("core") <= reach)
    cores = durable(d.table.select("grp", "uid", "vec").join(inside.select("uid", "core"), "uid").select(
        "grp", "uid", "vec", "core"), "cores")
    n = cores.count()
    if n < 2:
        return forest
    placed, pivots, radius, r_cells = _placed(cores, n, rows_per_cell)
    ends = [inside.select(F.col("uid").alias(e), F.col("core").alias(f"k_{e}")) for e in ("src", "dst")]
    known = lookup_join(lookup_join(near.filter(F.col("src") != F.col("dst")), ends[0], ["src"], ["dst"]),
                        ends[1], ["dst"], ["src"])
    edges = durable(known.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"),
        F.greatest("d", "k_src", "k_dst").alias("w")).filter(F.col("w") <= reach).distinct(), "edges")
    state = durable(inside.select("uid", F.col("uid").alias("comp"), "low"), "state")
    kernel = _outgoing_kernel(d.dims)
    grown = []
    while True:
        out = durable(_labelled(edges, state), "out")
        best = durable(_shortest(out), "best")
        found, state = _searched(placed, state, best, pivots, radius, r_cells, reach, d.dims, kernel, block_rows)
        if found is not None:
            out = durable(out.unionByName(_labelled(found, state)), "out")
            best = durable(_shortest(out), "best")
        if best.isEmpty():
            break
        grown.append(best.select("best.src", "best.dst", "best.w").distinct())
        state = durable(lookup_join(state, _joined(best), ["comp"], ["uid"], "left").select(
            "uid", F.coalesce("_to", "comp").alias("comp"), "low"), "state")
        edges = out.select("src", "dst", "w")
    if grown:
        forest.edges = durable(union_all(grown), "forest")
    return forest


def _searched(placed, state, best, pivots, radius, r_cells, reach, dims, kernel, block_rows):
    """(found edges or None, state): a search for every vector whose unlisted edges may matter.

    What a search does not find within its bound raises the vector's own bound ``low`` from below.
    """
    known = F.col("_w").isNotNull()
    asked = lookup_join(state, best.select("comp", F.col("best.w").alias("_w")), ["comp"], ["uid"], "left")
    asked = durable(asked.filter(F.when(known, F.col("low") < F.col("_w")).otherwise(F.col("low") <= reach)).select(
        "uid", "comp", F.coalesce("_w", F.lit(float(reach))).alias("bound"),
        F.when(known, F.col("_w")).otherwise(F.lit(_NEVER)).alias("_next")), "asked")
    if asked.isEmpty():
        return None, state
    here = durable(placed.join(state.select("uid", "comp"), "uid"), "here")
    queries = here.drop("cell", "comp").join(asked.drop("_next"), "uid").select(*_ASKED)
    if pivots is None:
        visits = durable(queries.withColumn("cell", F.lit(0)), "visits")
    else:
        held = here.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).collect()
        only = {r["cell"]: r["a"] for r in held if r["a"] == r["b"]}  # at most MAX_CELLS entries
        visits = durable(queries.mapInArrow(
            _outward_kernel(pivots, radius, only),
            "grp long, uid long, vec array<double>, core double, comp long, bound double, cell int"), "visits")
    met = nb._meet(visits, here, nb._cell_counts(visits), r_cells, dims, kernel, ("core", "comp"),
                   block_rows, ("core", "comp", "bound"))
    found = durable(met.groupBy("src").agg(F.min(F.struct("d", "dst")).alias("e")).select(
        "src", "e.dst", F.col("e.d").alias("w")), "found")
    tried = asked.select("uid", "_next").join(
        found.select(F.col("src").alias("uid"), F.col("w").alias("_w")), "uid", "left").select(
        "uid", F.coalesce("_w", "_next").alias("_low"))
    state = durable(lookup_join(state, tried, ["uid"], ["uid"], "left").select(
        "uid", "comp", F.coalesce("_low", "low").alias("low")), "state")
    return found, state


# --- cuts -----------------------------------------------------------------------------------------

def density_cuts(forest: DensityForest, radii: list[float]) -> DataFrame:
    """(run, id, cid, kind) of every radius; run is its place in the list, the rest as in ``dbscan``.

    All radii share one component job. A row that is no core at a radius has fewer than
    ``min_samples`` rows within it, so its neighbour list holds every core it may border on.
    """
    if any(e > forest.reach for e in radii):
        raise ValueError(f"the forest reaches {forest.reach}; no cut above it is known")
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("graph"), F.lit(float(e)).alias("eps"))
                               for i, e in enumerate(radii)])).alias("r")
    at = durable(forest.core.select("uid", "core", each).select(
        F.col("r.graph").alias("graph"), "uid", "r.eps",
        F.coalesce(F.col("core") <= F.col("r.eps"), F.lit(False)).alias("inner")), "at")
    links = forest.edges.select("src", "dst", "w", each).filter(F.col("w") <= F.col("r.eps")).select(
        "r.graph", "src", "dst")
    comp = durable(connected_components(links, at.filter("inner").select(
        "graph", F.col("uid").alias("id"))), "comp")
    loose = at.filter(~F.col("inner")).select("graph", F.col("uid").alias("src"), "eps")
    close = forest.near.filter(F.col("d") <= float(max(radii, default=0.0)))
    touch = loose.join(close, "src").filter(F.col("d") <= F.col("eps")).select("graph", "src", "dst")
    border = lookup_join(touch, comp.withColumnRenamed("id", "dst"), ["graph", "dst"], ["src"]).groupBy(
        "graph", "src").agg(F.min("comp").alias("comp"))
    named = comp.select("graph", F.col("id").alias("uid"), F.col("comp").alias("cid"), F.lit("core").alias("kind"))
    edge = border.select("graph", F.col("src").alias("uid"), F.col("comp").alias("cid"), F.lit("border").alias("kind"))
    rest = loose.select("graph", F.col("src").alias("uid")).join(edge, ["graph", "uid"], "left")
    flat = durable(named.unionByName(rest), "flat")
    return lookup_join(forest.rows, flat, ["uid"], ["id"]).select(
        F.col("graph").alias("run"), "id", F.coalesce("cid", F.lit(-1) - F.col("id")).alias("cid"),
        F.coalesce("kind", F.lit("noise")).alias("kind"))


def dbscan_sweep(points: DataFrame, radii: list[float], min_samples: int = 5, **blocks) -> DataFrame:
    """(run, id, cid, kind): ``dbscan`` at every radius from one forest."""
    return density_cuts(density_forest(points, float(max(radii)), min_samples, **blocks), radii)
