import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmloom.llm import neighbors, queries


def exact(rows, asked, k):
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    out = []
    for q in sorted({i for i in ids if asked(i)}):
        a = np.repeat(x[ids == q][:1], len(x), 0)
        s = neighbors.cosine(a, x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(int(q), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.op6_nearest_neighbours(spark, sf)) == exact(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("block,query_block", [(8192, 2048), (37, 5), (1000, 1)])
def test_blocks_ties_and_near_copies(spark, block, query_block):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12))
    x[100:200] = x[0] * rng.choice([0.5, 1.0, 2.0], (100, 1))  # equal directions
    x[200:260] = x[0] + rng.normal(size=(60, 12)) * 1e-6  # nearer than int8 can tell
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbors.nearest(df, F.col("vec_id") % 20 == 0, block=block, query_block=query_block))
    assert got == exact(rows, lambda i: i % 20 == 0, 5)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, [1.0, 2.0, 3.0]), (8, [1e300, 1e300]), (9, [1e-300, 0.0]), (None, [1.0, 0.0]), (50, [0.0, 0.0]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "q", "s") for r in rows], "vec_id long, embedding array<double>, qb string, score string")
    got = found(neighbors.nearest(df, F.col("vec_id") % 50 == 0))
    part = [(i, v) for i, v in rows if i in (0, 1, 8, 9, 100)]
    assert [g[:3] for g in got] == [w[:3] for w in exact(part, lambda i: i % 50 == 0, 5)]
    assert neighbors.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbors.nearest(df.filter("vec_id in (1, 2)"), F.col("vec_id") % 50 == 0).count() == 0
    alone = neighbors.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 50 == 0)
    assert alone.count() == 0
