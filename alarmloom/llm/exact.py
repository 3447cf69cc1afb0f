"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical without white space (blank, tab, line feed, vertical tab, form feed, carriage
return). Rows are told apart in three steps, each on the groups that the one before it left with several rows:

1. by the number of bytes that remain without white space: a table of lengths with their counts;
2. by the hash of the first ``PREFIX`` remaining characters;
3. by SHA-256 of all remaining bytes. Only rows that share length and prefix hash with another row get here.

Counts are combined before every shuffle. Texts are only shuffled when the table of shared prefixes is beyond
``SMALL`` bytes; the keys with a large share of all rows are broadcast then as well, so that a group
of copies with a third of all rows stays spread. On the way back rows travel as numbers and hashes.

Of equal texts the row with the most code points in its original text stays, then the least id, then (rows that agree in
both) any one of them: exactly one row of a group stays. Null texts are empty texts and equal each other and
all texts of white space; a null id is the least id. Repeated rows are rows of their own. No rows give no rows.
Columns besides id and text are not read by ``decisions`` and are kept, whatever their names, by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from .common import col, share_join, tune

SPACE = " \t\n\v\f\r"
PREFIX = 64
# Bytes of a written table that is broadcast whole.
SMALL = 4 * 1024 * 1024


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _measured(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, text, norm, size, prefix, ...) of every row."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), normalised(text).alias("norm"), *more)
    return rows.select("*", F.octet_length("norm").alias("size"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"))


def _shared(rows: DataFrame, small: int) -> DataFrame:
    """(size, prefix, n): what several rows share; steps 1 and 2."""
    times = F.count(F.lit(1)).alias("n")
    lengths = durable(rows.groupBy("size").agg(times).filter("n > 1"), "exact")
    left = share_join(rows.select("size", "prefix"), lengths, ["size"], limit=small).drop("n")
    return durable(left.groupBy("size", "prefix").agg(times).filter("n > 1"), "exact")


def decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_hash: bool = False, small: int = SMALL,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    ``text_sha256`` is null for rows that step 2 told apart from all others, unless ``every_hash`` asks for it."""
    tune(docs.sparkSession)
    rows = _measured(docs, id_col, text_col)
    met = share_join(rows, _shared(rows, small), ["size", "prefix"], "left", small)
    hashed = F.sha2(F.col("norm").cast("binary"), 256)
    named = durable(met.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").alias("points"),
        F.col("n").isNotNull().alias("met"),
        (hashed if every_hash else F.when(F.col("n").isNotNull(), hashed)).alias("text_sha256")), "exact")
    best = F.min(F.struct((-F.col("points")).alias("less"), "doc_id", "row")).alias("best")
    groups = durable(named.filter("met").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), best).filter("n > 1"), "exact")
    grouped = F.col("n").isNotNull()
    return share_join(named, groups, ["text_sha256"], "left", small).select(
        "doc_id", F.when(grouped, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | (F.col("best.row") == F.col("row"))).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    tune(docs.sparkSession)
    rows = _measured(docs, id_col, text_col, F.struct(*map(col, docs.columns)).alias("row"))
    met = share_join(rows, _shared(rows, small), ["size", "prefix"], "left", small)
    alone = met.filter("n is null").select("row")
    order = F.struct(-F.char_length("text"), "doc_id", F.xxhash64("text"))
    best = met.filter("n is not null").groupBy(F.sha2(F.col("norm").cast("binary"), 256).alias("sha")).agg(
        F.min_by("row", order).alias("row"))
    return alone.unionByName(best.select("row")).select("row.*")
