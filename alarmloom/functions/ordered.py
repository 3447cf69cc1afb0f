"""Running totals, ranks and exact quantiles over rows that do not fit one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable

# Rows one window partition may hold before the order column is cut into ranges.
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 4096
# Selection of order statistics: accuracy of the sketches, and values that may be sorted at once.
SKETCH_ACCURACY = 10_000
SORTED_AT_ONCE = 100_000


def running_totals(
    df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` (source -> output) by descending ``order`` within ``by``.

    ``df`` has one row per (by, order) and is a written table, so it can be read twice. Beyond
    ``ROWS_PER_RANGE`` rows the order column is cut at its quantiles; each range sums its own rows
    and adds the totals of the higher ranges, so no task sorts more than one range.
    """
    by = by or []
    rows = df.count() if rows is None else rows
    if rows <= ROWS_PER_RANGE:
        w = (
            Window.partitionBy(*by).orderBy(F.col(order).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.select("*", *[F.sum(s).over(w).alias(o) for s, o in sums.items()])
    pieces = min(MAX_RANGES, -(-rows // ROWS_PER_RANGE) * 2)
    cuts = sorted(set(df.approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.1 / pieces)))
    cut = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_order", outputCol="_range"
    )
    ranged = cut.transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order")
    higher = (
        Window.partitionBy(*by).orderBy(F.col("_range").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_t_{o}") for s, o in sums.items()])
        .select(
            *by, "_range",
            *[F.coalesce(F.sum(f"_t_{o}").over(higher), F.lit(0)).alias(f"_o_{o}")
              for o in sums.values()],
        )
    )
    w = (
        Window.partitionBy(*by, "_range").orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # offsets: at most MAX_RANGES rows per group, turned into a broadcast at run time when small
    local = ranged.select("*", *[F.sum(s).over(w).alias(o) for s, o in sums.items()])
    joined = local.join(offsets, [*by, "_range"])
    return joined.select(
        *df.columns, *[(F.col(o) + F.col(f"_o_{o}")).alias(o) for o in sums.values()]
    )


def value_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Written table of distinct values with their row counts and ``n_ge`` = rows at or above."""
    by = by or []
    counts = durable(
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n_here")),
        "values",
    )
    return running_totals(counts, "value", {"n_here": "n_ge"}, by)


def exact_quantile(
    counted: DataFrame, q: Column, by: list[str] | None = None, out: str = "quantile"
) -> DataFrame:
    """Linear-interpolation quantile per group from ``value_counts``; q may differ by group.

    The two order statistics next to the position are found by filtering the running counts, so
    nothing is gathered per group.
    """
    by = by or []
    totals = counted.groupBy(*by).agg(F.sum("n_here").alias("_n"))
    if by:
        rows = counted.join(totals, by)
    else:
        rows = counted.withColumn("_n", F.lit(totals.head()["_n"]))
    position = (F.col("_n") - 1) * q
    at = rows.withColumn("_h", position).withColumn("_below", F.col("_n") - F.col("n_ge"))
    low, high = F.floor("_h"), F.ceil("_h")

    def covers(i: Column) -> Column:
        return (F.col("_below") <= i) & (i < F.col("_below") + F.col("n_here"))

    ends = at.filter(covers(low) | covers(high)).groupBy(*by).agg(
        F.max(F.when(covers(low), F.col("value"))).alias("_lo"),
        F.max(F.when(covers(high), F.col("value"))).alias("_hi"),
        F.max(F.col("_h") - low).alias("_part"),
    )
    return ends.select(
        *by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out)
    )


class _Rank:
    """An order statistic: it is the ``rank``-th (from 0) of the ``n`` values between ``low`` and ``high``, both outside."""

    def __init__(self, rank: int, n: int):
        self.rank, self.n, self.low, self.high, self.value = rank, n, None, None, None

    def inside(self, v: Column) -> Column:
        test = v.isNotNull()
        if self.low is not None:
            test = test & (v > F.lit(self.low))
        return test if self.high is None else test & (v < F.lit(self.high))

    def between(self, v: Column) -> Column:
        """Two values that the rank lies between, from a sketch of the values that are left."""
        p, slack = (self.rank + 0.5) / self.n, 2.0 / SKETCH_ACCURACY
        ends = [max(p - slack, 0.0), min(p + slack, 1.0)]
        return F.percentile_approx(F.when(self.inside(v), v), ends, SKETCH_ACCURACY)

    def counts(self, v: Column, a: float, b: float) -> Column:
        here, a, b = self.inside(v), F.lit(a), F.lit(b)
        return F.array(F.count_if(here & (v < a)), F.count_if(here & (v == a)), F.count_if(here & (v > a) & (v < b)),
                       F.count_if(here & (v == b) & (a < b)))

    def narrow(self, a: float, b: float, counts: list[int]) -> None:
        """Go on with the part that holds the rank, wherever the sketch put its ends: at least one value drops out."""
        below, at_a, middle, at_b = counts
        if self.rank < below:
            self.high, self.n = a, below
        elif self.rank < below + at_a:
            self.value = a
        elif self.rank < below + at_a + middle:
            self.low, self.high, self.rank, self.n = a, b, self.rank - below - at_a, middle
        elif self.rank < below + at_a + middle + at_b:
            self.value = b
        else:
            gone = below + at_a + middle + at_b
            self.low, self.rank, self.n = b, self.rank - gone, self.n - gone


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Linear-interpolation quantiles of all rows, exact, by selection; nulls do not count, without a value None.

    A sketch brackets every order statistic, exact counts say on which side of the ends it lies, and only the values inside go
    on, about 1 in 2 000 of them a turn; what is left of at most SORTED_AT_ONCE is sorted. All shares go through the same jobs; nothing is
    shuffled but sketches and counts, and nothing is written. Equal values cannot hold a turn up, since the ends themselves drop out.
    """
    v = F.col(value).cast("double")
    n = df.agg(F.count(v).alias("n")).head()["n"]
    if not n:
        return [None for _ in shares]
    at = [(n - 1) * q for q in shares]
    ranks = {k: _Rank(k, n) for h in at for k in (math.floor(h), math.ceil(h))}
    while wide := [r for r in ranks.values() if r.value is None and r.n > SORTED_AT_ONCE]:
        ends = df.agg(*[r.between(v).alias(f"r{i}") for i, r in enumerate(wide)]).head()
        found = df.agg(*[r.counts(v, *e).alias(f"r{i}") for i, (r, e) in enumerate(zip(wide, ends))]).head()
        for r, e, c in zip(wide, ends, found):
            r.narrow(*e, c)
    if few := [r for r in ranks.values() if r.value is None]:
        got = df.agg(*[F.get(F.sort_array(F.collect_list(F.when(r.inside(v), v))), r.rank).alias(f"r{i}")
                       for i, r in enumerate(few)]).head()
        for r, x in zip(few, got):
            r.value = x
    out = []
    for h in at:
        low, high = ranks[math.floor(h)].value, ranks[math.ceil(h)].value
        out.append(low if low == high else low + (high - low) * (h - math.floor(h)))
    return out


def dense_rank_global(df: DataFrame, order: str, out: str, by: list[str] | None = None) -> DataFrame:
    """0-based rank by ascending unique ``order`` within ``by`` without a one-task sort."""
    negated = durable(
        df.withColumn("_neg", -F.col(order)).withColumn("_one", F.lit(1).cast("long")), "rank"
    )
    ranked = running_totals(negated, "_neg", {"_one": "_rank"}, by)
    return ranked.withColumn(out, F.col("_rank") - 1).drop("_neg", "_one", "_rank")
