"""Stratified samples and splits that give the same rows for a seed on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_fraction, hash_key
from ..runtime import durable

# Hash ranges per stratum; a stratum of 1e11 rows ranks about 25 million of them in one task.
PIECES = 4096


def _draw(df: DataFrame, strata: list[str], id_col: str, take, seed: int, flag: str) -> DataFrame:
    """Flag the ``take(n)`` rows of each stratum (n = its size) with the smallest hash keys.

    The hash fraction is cut into PIECES ranges. Ranges wholly below or above the cut-off are
    decided by their counts alone; only the one range that holds the cut-off is ranked. A stratum
    with a third of all rows is therefore never sorted in one task.
    """
    piece = F.floor(hash_fraction(seed, F.col(id_col)) * PIECES).cast("int")
    keyed = df.withColumn("_piece", piece)
    counts = keyed.groupBy(*strata, "_piece").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*strata)
    upto = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = counts.select(
        *strata, "_piece",
        take(F.sum("_n").over(whole)).alias("_take"),
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.col("_n"),
    )
    same = [F.col(f"k.{s}").eqNullSafe(F.col(f"q.{s}")) for s in strata]
    placed = keyed.alias("k").join(
        quota.alias("q"), [*same, F.col("k._piece") == F.col("q._piece")]
    ).select("k.*", "q._take", "q._before", "q._n")
    inside = (F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_n") > F.col("_take"))
    edge = Window.partitionBy(*strata, "_piece").orderBy(
        hash_key(seed, F.col(id_col)), F.col(id_col)
    )
    decided = placed.filter(~inside).withColumn(
        flag, F.col("_before") + F.col("_n") <= F.col("_take")
    )
    ranked = placed.filter(inside).withColumn(
        flag, F.row_number().over(edge) + F.col("_before") <= F.col("_take")
    )
    cols = [*df.columns, flag]
    return decided.select(*cols).unionByName(ranked.select(*cols))


def stratified_fraction(
    df: DataFrame, frac: float, by: list[str], id_col: str, seed: int = 42
) -> DataFrame:
    """max(1, ceil(frac * n)) rows of each (file, chunk, label) group."""
    take = lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(frac)))
    return _draw(df, by, id_col, take, seed, "_in").filter("_in").drop("_in")


def stratified_subsample(
    df: DataFrame, label: str, id_col: str, frac: float | None = None,
    max_per_class: int | None = None, seed: int = 42,
) -> DataFrame:
    """Cap per class (takes priority), else a stratified fraction, else the input."""
    if max_per_class is not None:
        take = lambda n: F.least(F.lit(max_per_class), n)
    elif frac is not None and 0 < frac < 1:
        take = lambda n: F.ceil(n * F.lit(frac))
    else:
        return df
    return _draw(df, [label], id_col, take, seed, "_in").filter("_in").drop("_in")


def train_test_split(
    df: DataFrame, label: str | None, id_col: str, test_size: float = 0.3, seed: int = 42,
    exact: bool = True,
) -> DataFrame:
    """Add ``split`` in {train, test}: ceil(test_size * n) test rows per class.

    ``exact=False`` compares the hash with test_size: no shuffle, and a binomially varying count.
    """
    if not exact:
        test = hash_fraction(seed, F.col(id_col)) < F.lit(test_size)
        return df.withColumn("split", F.when(test, "test").otherwise("train"))
    take = lambda n: F.ceil(n * F.lit(test_size))
    base = df if label else df.withColumn("_all", F.lit(0))
    drawn = _draw(base, [label or "_all"], id_col, take, seed, "_in")
    return drawn.select(*df.columns, F.when(F.col("_in"), "test").otherwise("train").alias("split"))


def validation_test_split(
    df: DataFrame, val_ratio: float = 0.3, seed: int = 42, min_per_class: int = 10
) -> DataFrame | None:
    """Add ``side`` in {val, test}; None when either class has fewer than ``min_per_class`` rows."""
    n = df.agg(
        F.count_if(F.col("y_true") == 0).alias("fp"), F.count_if(F.col("y_true") == 1).alias("tp")
    ).head()
    if n["fp"] < min_per_class or n["tp"] < min_per_class:
        return None
    cut = train_test_split(df, "y_true", "index", 1.0 - val_ratio, seed)
    side = F.when(F.col("split") == "test", "test").otherwise("val")
    return cut.withColumn("side", side).drop("split")


def capped_subsample(df: DataFrame, cap: int, id_col: str, seed: int = 42) -> DataFrame:
    """Uniform sample of ``cap`` rows when there are more, else all rows."""
    rows = df.count()
    if rows <= cap:
        return df
    # The hash threshold keeps a little over cap rows; the exact cut then ranks only those.
    loose = min(1.0, (cap + 6.0 * cap**0.5 + 50.0) / rows)
    near = durable(df.filter(hash_fraction(seed, F.col(id_col)) < F.lit(loose)), "sample")
    pool = near if near.count() >= cap else df
    return pool.orderBy(hash_key(seed, F.col(id_col)), F.col(id_col)).limit(cap)
