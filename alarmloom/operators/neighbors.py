"""Exact nearest-neighbour and range joins.

Vectors are first collapsed to distinct ones, so any number of copies costs one vector. Distinct
reference vectors are dealt to cells around sampled pivots, and cells are cut into blocks of bounded
size. A query block meets a reference block through an equi-join on the cell, and a small numpy
kernel keeps at most k neighbours per query and block; it looks at a bounded tile of distances at a time
and hands on every block pair by itself, so that a task's memory does not grow with its pairs. Cells are visited in two rounds: the nearest
cells give an upper bound of the k-th distance, and the second round visits every other cell that
the triangle inequality cannot exclude and hands on only what lies within the bound. No candidate is dropped, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT, bounded_batches, durable, lookup_join, union_all

BLOCK_ROWS = 1024
ROWS_PER_CELL = 16 * BLOCK_ROWS
# Rows of a reference block: queries are copied, and their neighbours ranked, once for each of these.
REF_ROWS = ROWS_PER_CELL
# Distances a kernel holds at once, and rows that a visiting query block may become before they are handed on.
TILE = 1 << 20
VISITS = 8192
MAX_CELLS = 4096
_SLACK = 1e-9


# --- numpy kernels (run inside tasks on one pair of blocks) -------------------------------------

def _matrix(column: pa.Array, dims: int) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b].reshape(-1, dims) for a, b in zip(ends[:-1], ends[1:])]


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _tiles(q: np.ndarray, r: np.ndarray) -> list[slice]:
    """Runs of queries that have at most ``TILE`` distances to ``r``."""
    step = max(1, TILE // max(1, len(r)))
    return [slice(i, i + step) for i in range(0, len(q), step)]


def _squared(q: np.ndarray, r: np.ndarray, rr: np.ndarray | None = None) -> np.ndarray:
    """Squared distances by the product form: fast, off by rounding only; ``rr`` are the squared lengths of ``r``."""
    s = q @ r.T
    s *= -2.0
    s += (q * q).sum(1)[:, None]
    s += ((r * r).sum(1) if rr is None else rr)[None, :]
    return np.maximum(s, 0.0, out=s)


def _tolerance(q: np.ndarray, r: np.ndarray, rr: np.ndarray | None = None) -> float:
    rr = (r * r).sum(1) if rr is None else rr
    top = max(float((q * q).sum(1).max(initial=0.0)), float(rr.max(initial=0.0)))
    return 1e-12 * (1.0 + 4.0 * top)


def _exact(q: np.ndarray, r: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    total = np.zeros(len(qi))
    for j in range(q.shape[1]):
        d = q[qi, j] - r[ri, j]
        total += d * d
    return np.sqrt(total)


def _nearest_in_block(q, qid, r, rid, k, bound=None):
    """Up to k nearest per query (distance, then id), recomputed exactly after a fast screen.

    ``bound`` is a distance that the k nearest of all blocks do not exceed: what lies beyond it is left out.
    """
    rr, parts = (r * r).sum(1), []
    lengths = np.column_stack([r, rr]).T
    for tile in _tiles(q, r):
        x = q[tile]
        # squared distances less the squared length of the query, which does not change its order: one product, no other pass
        s = np.column_stack([-2.0 * x, np.ones(len(x))]) @ lengths
        near = None
        if bound is not None:
            near = s <= (bound[tile] ** 2 - (x * x).sum(1) + _tolerance(x, r, rr))[:, None]
            if np.count_nonzero(near) > 4 * k * len(x):  # a loose bound: the block's own k nearest are fewer
                near = None
        if near is not None:
            qi, ri = np.nonzero(near)
        elif r.shape[0] > k:
            cut = np.partition(s, k - 1, axis=1)[:, k - 1] + _tolerance(x, r, rr)
            qi, ri = np.nonzero(s <= cut[:, None])
        else:
            qi, ri = (i.ravel() for i in np.indices(s.shape))
        d = _exact(x, r, qi, ri)
        order = np.lexsort((rid[ri], d, qi))
        qi, ri, d = qi[order], ri[order], d[order]
        first = np.searchsorted(qi, np.arange(x.shape[0]))
        keep = np.arange(len(qi)) - first[qi] < k
        parts.append((qid[tile][qi[keep]], rid[ri[keep]], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _found(g: int, src, dst, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(src), g, dtype=np.int64)), pa.array(src), pa.array(np.asarray(dst, dtype=np.int64)), pa.array(d)],
        names=["grp", "src", "dst", "d"])


def _nearest_kernel(dims: int, k: int, bounded: bool = False):
    def run(batches):
        for b in batches:
            cols = (b.column("grp").to_pylist(), _lists(b.column("q_ids")),
                    _matrix(b.column("q_vecs"), dims), _lists(b.column("r_ids")),
                    _matrix(b.column("r_vecs"), dims),
                    _lists(b.column("q_bound")) if bounded else [None] * b.num_rows)
            for g, qid, q, rid, r, bound in zip(*cols):
                yield _found(g, *_nearest_in_block(q, qid, r, rid, k, bound))
    return run


def _within_kernel(dims: int, eps: float, mode: str):
    """mode 'pairs': pairs within eps; 'count': neighbours per query; 'forest': a spanning forest
    of the pairs, at most one edge per row of the two blocks, with the same components."""
    def run(batches):
        for b in batches:
            cols = (b.column("grp").to_pylist(), _lists(b.column("q_ids")),
                    _matrix(b.column("q_vecs"), dims), _lists(b.column("r_ids")),
                    _matrix(b.column("r_vecs"), dims), _lists(b.column("r_mult")))
            for g, qid, q, rid, r, mult in zip(*cols):
                rr, bits = (r * r).sum(1), []
                for tile in _tiles(q, r):
                    near = _near(q[tile], r, rr, eps)
                    if mode == "count":
                        n = near @ mult
                        yield _found(g, qid[tile][n > 0], n[n > 0], np.zeros(int((n > 0).sum())))
                    elif mode == "pairs":
                        qi, ri = np.nonzero(near)
                        yield _found(g, qid[tile][qi], rid[ri], _exact(q[tile], r, qi, ri))
                    else:
                        bits.append(near)
                if mode == "forest":
                    qi, ri = _forest(np.concatenate(bits))
                    yield _found(g, qid[qi], rid[ri], np.zeros(len(qi)))
    return run


def _near(q, r, rr, eps) -> np.ndarray:
    """Which pairs lie within ``eps``; those that rounding leaves open are measured exactly."""
    s = _squared(q, r, rr)
    tol = _tolerance(q, r, rr)
    near = s <= eps * eps - tol
    qi, ri = np.nonzero(~near & (s <= eps * eps + tol))
    hit = _exact(q, r, qi, ri) <= eps
    near[qi[hit], ri[hit]] = True
    return near


def _pieces(batches):
    """Batches cut to ``BLOCK_ROWS`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(at, BLOCK_ROWS)


def _visited(b: pa.RecordBatch, names, rows: np.ndarray, cells: np.ndarray):
    """The given rows of a batch with the cells they visit, ``VISITS`` at a time."""
    for at in range(0, len(rows), VISITS):
        part = pa.array(rows[at:at + VISITS])
        yield pa.RecordBatch.from_arrays(
            [*[b.column(n).take(part) for n in names], pa.array(cells[at:at + VISITS].astype(np.int32))], names=[*names, "cell"])


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first spanning forest of a bipartite 0/1 matrix."""
    q_open, r_open = near.any(1), near.any(0)
    qs, rs = [], []
    for start in range(near.shape[0]):
        if not q_open[start]:
            continue
        q_open[start] = False
        front = [start]
        while front:
            nxt = []
            for i in front:
                for j in np.nonzero(near[i] & r_open)[0]:
                    r_open[j] = False
                    qs.append(i), rs.append(j)
                    for i2 in np.nonzero(near[:, j] & q_open)[0]:
                        q_open[i2] = False
                        qs.append(i2), rs.append(j)
                        nxt.append(i2)
            front = nxt
    return np.asarray(qs, dtype=np.int64), np.asarray(rs, dtype=np.int64)


def _cell_kernel(pivots: np.ndarray):
    """Nearest pivot and the distance to it."""
    def run(batches):
        for b in _pieces(batches):
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
            s = _squared(x, pivots)
            cell = s.argmin(1)
            d = _exact(x, pivots, np.arange(len(x)), cell)
            out = [b.column(n) for n in b.schema.names] + [pa.array(cell.astype(np.int32)), pa.array(d)]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "cell", "pd"])
    return run


def _visit_kernel(pivots: np.ndarray, radius: dict, counts: dict, k: int, bounded: bool):
    """Cells a query has to visit: the home cells without a bound, the remaining ones with it."""
    gap = np.sqrt(_squared(pivots, pivots))

    def run(batches):
        for b in _pieces(batches):
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
            dist = np.sqrt(_squared(x, pivots))
            groups = b.column("grp").to_numpy(zero_copy_only=False)
            bound = b.column("bound").to_numpy(zero_copy_only=False) if bounded else None
            take, cells = [], []
            for i, g in enumerate(groups):
                rad, cnt = radius.get(g), counts.get(g)
                if rad is None:
                    continue
                order = np.argsort(dist[i], kind="stable")
                full = np.cumsum(cnt[order])
                home = order[: int(np.searchsorted(full, min(k, full[-1]))) + 1]
                if not bounded:
                    chosen = home[cnt[home] > 0]
                else:
                    near = order[0]
                    away = dist[i] - rad
                    side = (dist[i] ** 2 - dist[i, near] ** 2) / np.maximum(2.0 * gap[near], 1e-300)
                    side[near] = 0.0
                    reach = bound[i] * (1 + _SLACK) + 1e-6
                    need = (cnt > 0) & (away <= reach) & (side <= reach)
                    need[home] = False
                    chosen = np.nonzero(need)[0]
                take.append(np.full(len(chosen), i)), cells.append(chosen)
            if take:
                names = ("grp", "uid", "vec", "bound") if bounded else ("grp", "uid", "vec")
                yield from _visited(b, names, np.concatenate(take), np.concatenate(cells))
    return run


# --- DataFrame side -----------------------------------------------------------------------------

class Distinct:
    """Distinct vectors of a point table (grp, id, vec): written once, read by every round."""

    def __init__(self, points: DataFrame, copies: int):
        self.points = points
        self.copies = copies
        self.table = durable(
            points.groupBy("grp", "vec").agg(F.min("id").alias("uid"), F.count("*").alias("mult")),
            "distinct",
        )
        per = self.table.groupBy("grp").agg(
            F.count("*").alias("u"), F.sum("mult").alias("n"), F.max(F.size("vec")).alias("d")
        ).collect()
        self.by_group = {r["grp"]: r["u"] for r in per}
        self.rows = sum(r["u"] for r in per)
        self.total = sum(r["n"] for r in per)
        self.dims = max((r["d"] for r in per), default=0)

    def representatives(self) -> DataFrame:
        """(grp, dst uid, reps): the lowest ids of each distinct vector, as many as can be listed."""
        firsts = Window.partitionBy("grp", "vec").orderBy("id")
        few = self.points.withColumn("_r", F.row_number().over(firsts)).filter(
            F.col("_r") <= self.copies
        )
        reps = few.groupBy("grp", "vec").agg(
            F.min("id").alias("dst"), F.sort_array(F.collect_list("id")).alias("reps")
        )
        return reps.select("grp", "dst", "reps")

    def members(self) -> DataFrame:
        """(grp, id, uid) for every point."""
        if self.rows == self.total:
            return self.points.select("grp", "id", F.col("id").alias("uid"))
        keys = self.table.select("grp", "vec", "uid")
        return lookup_join(self.points, keys, ["grp", "vec"], ["id"]).select("grp", "id", "uid")

    def expanded(self, pairs: DataFrame, end: str, other: str) -> DataFrame:
        """Pairs of distinct vectors with every copy in place of the uid in ``end``; only copied vectors are looked up."""
        if self.rows == self.total:
            return pairs
        keys = self.table.filter("mult > 1").select("grp", "vec", "uid")
        copied = durable(lookup_join(self.points, keys, ["grp", "vec"], ["id"]).select(
            F.col("uid").alias(end), F.col("id").alias("_copy")), "copies")
        return lookup_join(pairs, copied, [end], [other], "left").withColumn(end, F.coalesce("_copy", end)).drop("_copy")


def _parallelism(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def _with_pieces(rows: DataFrame, cell_rows: dict, block_rows: int) -> DataFrame:
    """Add the number of blocks of the row's cell."""
    pieces = {key: max(1, -(-int(n) // block_rows)) for key, n in cell_rows.items()}
    if len(pieces) <= 16:
        case = F.lit(1)
        for (g, c), n in pieces.items():
            case = F.when((F.col("grp") == g) & (F.col("cell") == c), n).otherwise(case)
        return rows.withColumn("pieces", case)
    sizes = rows.sparkSession.createDataFrame(  # at most MAX_CELLS rows per group
        [(int(g), int(c), n) for (g, c), n in pieces.items()], "grp long, cell int, pieces int"
    )
    return rows.join(F.broadcast(sizes), ["grp", "cell"])


def _blocks(rows: DataFrame, prefix: str, block_rows: int, cell_rows: dict, extra=()) -> DataFrame:
    """Rows of a cell packed into blocks of about ``block_rows``."""
    cut = _with_pieces(rows, cell_rows, block_rows).withColumn(
        f"{prefix}blk", F.pmod(F.xxhash64(F.lit(prefix), "uid"), F.col("pieces")).cast("int")
    )
    cols = [F.flatten(F.collect_list("vec")).alias(f"{prefix}_vecs"),
            F.collect_list("uid").alias(f"{prefix}_ids")]
    cols += [F.collect_list(e).alias(f"{prefix}_{e}") for e in extra]
    return cut.groupBy("grp", "cell", f"{prefix}blk").agg(*cols)


def _meet(queries: DataFrame, refs: DataFrame, q_cells: dict, r_cells: dict, dims: int,
          kernel, extra=(), block_rows: int | None = None, q_extra=()) -> DataFrame:
    """Run a kernel on every (query block, reference block) of the same cell."""
    bounded_batches(queries.sparkSession)
    n_q, n_r = sum(q_cells.values()), sum(r_cells.values())
    lanes = _parallelism(queries)
    q_rows = block_rows or max(32, min(BLOCK_ROWS, -(-n_q // (2 * lanes))))
    r_rows = block_rows or REF_ROWS
    qb = _blocks(queries, "q", q_rows, q_cells, q_extra)
    rb = _blocks(refs, "r", r_rows, r_cells, extra)
    if n_r * (dims + 2) * 8 <= BROADCAST_LIMIT // 4:
        # measured size: the reference rows are broadcast and the query blocks stay where they are
        pairs = qb.repartition(lanes, "grp", "cell", "qblk").join(F.broadcast(rb), ["grp", "cell"])
    else:
        spread = _with_pieces(qb, r_cells, r_rows).withColumn(
            "rblk", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        ).drop("pieces")
        # few reference blocks are copied, so that the query blocks of each are dealt to several tasks
        ways = -(-4 * lanes // sum(max(1, -(-int(n) // r_rows)) for n in r_cells.values()))
        spread = spread.withColumn("way", F.pmod(F.xxhash64("grp", "cell", "qblk"), F.lit(ways)).cast("int"))
        rb = rb.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        pairs = spread.join(rb.hint("merge"), ["grp", "cell", "rblk", "way"])
    wanted = ["grp", "q_ids", "q_vecs", "r_ids", "r_vecs", *[f"r_{e}" for e in extra],
              *[f"q_{e}" for e in q_extra]]
    return pairs.select(*wanted).mapInArrow(kernel, "grp long, src long, dst long, d double")


def _cell_counts(df: DataFrame) -> dict:
    rows = df.groupBy("grp", "cell").agg(F.count("*").alias("n")).collect()
    return {(r["grp"], r["cell"]): r["n"] for r in rows}


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("grp", "src").orderBy("d", "dst")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _pivot_cells(refs: Distinct, cells: int):
    """Sampled pivots, the reference cells, and their sizes and radii (at most MAX_CELLS rows)."""
    drawn = refs.table.select("vec").orderBy(F.xxhash64("vec")).limit(cells).collect()
    pivots = np.array([r["vec"] for r in drawn])
    placed = durable(
        refs.table.select("grp", "uid", "vec", "mult").mapInArrow(
            _cell_kernel(pivots),
            "grp long, uid long, vec array<double>, mult long, cell int, pd double",
        ), "cells",
    )
    stats = placed.groupBy("grp", "cell").agg(
        F.count("*").alias("n"), F.sum("mult").alias("m"), F.max("pd").alias("r")
    ).collect()
    radius, counts = {}, {}
    for s in stats:
        radius.setdefault(s["grp"], np.zeros(len(pivots)))[s["cell"]] = s["r"] * (1 + _SLACK)
        counts.setdefault(s["grp"], np.zeros(len(pivots)))[s["cell"]] = s["n"]
    r_cells = {(s["grp"], s["cell"]): s["n"] for s in stats}
    return pivots, placed, radius, counts, r_cells


def _distinct_neighbours(q: Distinct, r: Distinct, k: int, rows_per_cell: int,
                         block_rows: int | None) -> DataFrame:
    """(grp, src uid, dst uid, d): the k nearest distinct reference vectors of each query vector."""
    cells = min(MAX_CELLS, -(-r.rows // rows_per_cell))
    qs = q.table.select("grp", "uid", "vec")
    if cells <= 1:
        one = F.lit(0)
        sized = [{(g, 0): n for g, n in t.by_group.items()} for t in (q, r)]
        got = _meet(qs.withColumn("cell", one), r.table.select("grp", "uid", "vec").withColumn(
            "cell", one), *sized, r.dims, _nearest_kernel(r.dims, k), block_rows=block_rows)
        return _top(got, k)
    pivots, placed, radius, counts, r_cells = _pivot_cells(r, cells)

    def round_(frame, bounded):
        schema = f"grp long, uid long, vec array<double>, {'bound double, ' if bounded else ''}cell int"
        visits = durable(frame.mapInArrow(
            _visit_kernel(pivots, radius, counts, k, bounded), schema), "visits")
        return _meet(visits, placed, _cell_counts(visits), r_cells, r.dims, _nearest_kernel(r.dims, k, bounded),
                     block_rows=block_rows, q_extra=("bound",) if bounded else ())

    first = durable(_top(round_(qs, False), k).drop("rank"), "home")
    bounds = first.groupBy("grp", "src").agg(F.max("d").alias("far"), F.count("*").alias("n"))
    # fewer than k in the home cells only when the reference set itself has fewer than k vectors
    bounded = qs.join(bounds.withColumnRenamed("src", "uid"), ["grp", "uid"]).select(
        "grp", "uid", "vec", F.col("far").alias("bound")
    )
    return _top(first.unionByName(round_(bounded, True)), k)


def knn_join(
    queries: DataFrame, refs: DataFrame | None, k: int, exclude_self: bool = False,
    id_col: str = "index", vec_col: str = "features", by: str | None = None,
    rows_per_cell: int = ROWS_PER_CELL, block_rows: int | None = None,
) -> DataFrame:
    """(src, dst, d, rank): the k nearest reference rows of each query by (distance, id).

    ``refs=None`` joins the queries with themselves. ``by`` keeps separate sets apart in one join
    and is returned as ``grp``.
    """
    def points(df: DataFrame) -> DataFrame:
        grp = F.col(by).cast("long") if by else F.lit(0).cast("long")
        return df.select(grp.alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))

    need = k + 1 if exclude_self else k
    r = Distinct(points(queries if refs is None else refs), need)
    q = r if refs is None else Distinct(points(queries), 1)
    if r.rows == 0 or q.rows == 0:
        return queries.sparkSession.createDataFrame(
            [], "grp long, src long, dst long, d double, rank int")
    near = _distinct_neighbours(q, r, need, rows_per_cell, block_rows)
    if r.rows == r.total:
        listed = near.select("grp", "src", "dst", "d", "rank")
    else:
        spread = near.drop("rank").join(r.representatives(), ["grp", "dst"]).select(
            "grp", "src", F.explode("reps").alias("dst"), "d"
        )
        listed = _top(spread, need)
    if q.rows != q.total:
        lists = listed.groupBy("grp", "src").agg(
            F.collect_list(F.struct("rank", "dst", "d")).alias("near")  # at most k + 1 entries
        )
        members = q.members().withColumnRenamed("uid", "src")
        listed = lookup_join(members, lists, ["grp", "src"], ["id"]).select(
            "grp", F.col("id").alias("src"), F.explode("near").alias("x")
        ).select("grp", "src", "x.dst", "x.d", "x.rank")
    if not exclude_self:
        return listed
    w = Window.partitionBy("grp", "src").orderBy("rank")
    return (
        listed.filter(F.col("src") != F.col("dst"))
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    )


def kth_distance(knn: DataFrame, k: int | None = None) -> DataFrame:
    """(src, kdist): distance to the k-th listed neighbour."""
    rows = knn if k is None else knn.filter(F.col("rank") <= k)
    return rows.groupBy("grp", "src").agg(F.max("d").alias("kdist"))


def range_join(
    points: DataFrame, eps: float, mode: str = "pairs", others: DataFrame | None = None,
    id_col: str = "index", vec_col: str = "features", rows_per_cell: int = ROWS_PER_CELL,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows within ``eps`` (inclusive, self included).

    'pairs' returns (src, dst, d), 'count' (src, n) and 'forest' (src, dst): edges that connect
    exactly the rows which the pairs connect, linear in the number of rows.
    """
    def grouped(df):
        return df.select(F.lit(0).cast("long").alias("grp"), F.col(id_col).alias("id"),
                         F.col(vec_col).alias("vec"))

    q = Distinct(grouped(points), 1)
    r = q if others is None else Distinct(grouped(others), 1)
    spark = points.sparkSession
    if q.rows == 0 or r.rows == 0:
        return spark.createDataFrame([], "src long, dst long, d double")
    kernel = _within_kernel(r.dims, eps, mode)
    cells = min(MAX_CELLS, -(-r.rows // rows_per_cell))
    qs = q.table.select("grp", "uid", "vec")
    if cells <= 1:
        visits = qs.withColumn("cell", F.lit(0))
        placed = r.table.select("grp", "uid", "vec", "mult").withColumn("cell", F.lit(0))
        q_cells, r_cells = ({(g, 0): n for g, n in t.by_group.items()} for t in (q, r))
    else:
        pivots, placed, radius, counts, r_cells = _pivot_cells(r, cells)
        visits = durable(qs.withColumn("bound", F.lit(float(eps))).mapInArrow(
            _reach_kernel(pivots, radius, counts),
            "grp long, uid long, vec array<double>, cell int"), "visits")
        q_cells = _cell_counts(visits)
    found = _meet(visits, placed, q_cells, r_cells, r.dims, kernel, ("mult",),
                  block_rows)
    if mode == "count":
        per = found.groupBy("src").agg(F.sum("dst").alias("n"))
        ids = q.members().select("id", F.col("uid").alias("src"))
        return lookup_join(ids, per, ["src"], ["id"], "left").select(
            F.col("id").alias("src"), F.coalesce("n", F.lit(0)).alias("n"))
    if mode == "forest":
        copies = union_all([t.members().filter(F.col("id") != F.col("uid")).select(
            F.col("uid").alias("src"), F.col("id").alias("dst"))
            for t in ([q] if r is q else [q, r])])
        return found.select("src", "dst").filter(F.col("src") != F.col("dst")).unionByName(copies)
    return r.expanded(q.expanded(found.select("src", "dst", "d"), "src", "dst"), "dst", "src").select("src", "dst", "d")


def _reach_kernel(pivots: np.ndarray, radius: dict, counts: dict):
    def run(batches):
        for b in _pieces(batches):
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
            reach = b.column("bound").to_numpy(zero_copy_only=False)[:, None] + 1e-6
            dist = np.sqrt(_squared(x, pivots))
            need = (counts[0][None, :] > 0) & (dist - radius[0][None, :] <= reach)
            yield from _visited(b, ("grp", "uid", "vec"), *np.nonzero(need))
    return run


def majority_vote(
    queries: DataFrame, refs: DataFrame, label: str, k: int = 5, id_col: str = "index",
    vec_col: str = "features", by: str | None = None,
) -> DataFrame:
    """(src, label): most frequent label of the k nearest reference rows, lowest label on a tie."""
    near = knn_join(queries, refs, k, False, id_col, vec_col, by)
    tags = refs.select(
        (F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("grp"),
        F.col(id_col).alias("dst"), F.col(label).alias("_label"),
    )
    return vote(lookup_join(near, tags, ["grp", "dst"], ["src"])).withColumnRenamed("_label", label)


def vote(neighbour_labels: DataFrame) -> DataFrame:
    """Mode of ``_label`` per (grp, src) with the lowest label on a tie."""
    counts = neighbour_labels.groupBy("grp", "src", "_label").agg(F.count("*").alias("_c"))
    return counts.groupBy("grp", "src").agg(
        F.max_by("_label", F.struct(F.col("_c"), -F.col("_label"))).alias("_label")
    )

