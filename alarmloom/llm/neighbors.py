"""Nearest neighbours by cosine with a block matrix join of int8 tiles.

Vectors are scaled to length one and rounded to int8 with a scale of their own; the length of what rounding
cut off is kept. A tile of queries x candidates is one matrix product of small integers; with the lengths cut
off it bounds every cosine from both sides. Only pairs whose upper bound reaches the k-th best lower bound of
their query are recomputed in double precision from the original vectors, and merged into the query's list of
k. So the result is exact, ties by the smaller id included.

Queries and candidates are dealt to blocks of a fixed number of rows; a block of queries meets a block of
candidates once, by an equi-join on the query block's number. Vectors that are null, zero, or hold a null or a
component that is not finite take no part, nor do rows with a null id or of another length than most; repeated rows are
candidates of their own, and a query's own rows (same id) are not. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, lookup_join
from .common import col, tune

BLOCK = 8192
QUERY_BLOCK = 2048
FOUND = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)
    ).withColumn("dim", F.size("v"))


def blocks(rows: DataFrame, size: int, total: int) -> DataFrame:
    """(blk, ids, flat): rows packed by a hash of their place, about ``size`` to a block."""
    n = max(1, -(-total // size))
    blk = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "vec_id"), F.lit(n)).cast("int").alias("blk")
    return rows.select(blk, "vec_id", "v").groupBy("blk").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")).select(
        "blk", F.transform("rows", lambda r: r["vec_id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(small integers, scale, length of the rest) of unit vectors; integers are held as floats that multiply
    exactly, single precision up to 1 000 components."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(x - q * scale[:, None], axis=1)
    return q.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale, rest


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, components added in order; powers of two keep extreme vectors within range exactly."""
    a, b = (np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1]) for m in (a, b))
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        na += a[:, i] * a[:, i]
        nb += b[:, i] * b[:, i]
    return np.clip(dot / np.sqrt(na * nb), -1.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tile:
    """The k best candidates so far of one block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.q, self.scale, self.rest = quantised(unit(x))
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray, q: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        near = (self.q @ q.T).astype(np.float64) * self.scale[:, None] * scale[None, :]
        # |x.y - near| <= |rest of x| |y| + |rounded x| |rest of y|, and rounding in double precision
        slack = self.rest[:, None] + (1 + self.rest)[:, None] * rest[None, :] + 1e-9
        own = self.ids[:, None] == ids[None, :]
        lower = np.where(own, -np.inf, near - slack)
        k = min(self.k, len(ids))
        if len(ids) > k:
            bound = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            bound = lower.min(1)
        floor = self.best[:, -1] if len(ids) < self.k else np.maximum(bound, self.best[:, -1])
        i, j = np.nonzero((near + slack >= floor[:, None]) & ~own)
        for at in range(0, len(i), 1 << 16):
            self.merge(i[at:at + (1 << 16)], ids, x, j[at:at + (1 << 16)])

    def merge(self, i: np.ndarray, ids: np.ndarray, x: np.ndarray, j: np.ndarray) -> None:
        score = cosine(self.x[i], x[j])
        rows = np.unique(i)
        who = np.concatenate([np.repeat(rows, self.k), i])
        s = np.concatenate([self.best[rows].ravel(), score])
        v = np.concatenate([self.who[rows].ravel(), ids[j]])
        order = np.lexsort((v, -s, who))
        who, s, v = who[order], s[order], v[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < self.k
        self.best[who[top], rank[top]] = s[top]
        self.who[who[top], rank[top]] = v[top]

    def rows(self):
        i, r = np.nonzero(np.isfinite(self.best))
        return self.ids[i], self.who[i, r], self.best[i, r]


def _matrix(ids, flat) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(ids, np.int64)
    return ids, np.asarray(flat, np.float64).reshape(len(ids), -1)


class _Join:
    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches):
        import pyarrow as pa

        tiles: dict[int, Tile] = {}
        last, ready = None, ()
        for b in batches:
            for r in range(b.num_rows):
                qb, cb = b.column("qb")[r].as_py(), b.column("blk")[r].as_py()
                if qb not in tiles:
                    if len(tiles) >= 8:  # finish one, so that memory is bounded
                        yield self.out(tiles.pop(next(iter(tiles))), pa)
                    tiles[qb] = Tile(*_matrix(b.column("q_ids")[r].values.to_numpy(zero_copy_only=False),
                                              b.column("q_flat")[r].values.to_numpy(zero_copy_only=False)), self.k)
                if cb != last:
                    ids, x = _matrix(b.column("ids")[r].values.to_numpy(zero_copy_only=False),
                                     b.column("flat")[r].values.to_numpy(zero_copy_only=False))
                    last, ready = cb, (ids, x, *quantised(unit(x)))
                tiles[qb].meet(*ready)
        for t in tiles.values():
            yield self.out(t, pa)

    def out(self, tile: Tile, pa):
        q, v, s = tile.rows()
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``FOUND``: the k nearest rows of every row for which ``queries`` (an expression of ``vec_id``) holds."""
    tune(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").head()
    if common is None:
        return vectors.sparkSession.createDataFrame([], FOUND)
    rows = rows.filter(F.col("dim") == common["dim"])
    asked = rows.filter(queries).dropDuplicates(["vec_id"])
    n_asked = asked.count()
    cand = durable(blocks(rows, block, common["count"]), "ann")
    ask = durable(blocks(asked, query_block, n_asked), "ann").select(
        F.col("blk").alias("qb"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    n_ask = max(1, -(-n_asked // query_block))
    pairs = lookup_join(cand.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_ask - 1)))), ask, ["qb"], ["blk"])
    found = pairs.select("qb", "blk", "ids", "flat", "q_ids", "q_flat").mapInArrow(
        _Join(k), "query_id long, vec_id long, score double")
    # at most k rows per query and task
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id", "score")))
    top = found.groupBy("query_id").agg(F.slice(best, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
