"""Cleaning, labelling and encoding of raw flow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.ordered import dense_rank_global
from ..functions.scalars import finite_or_null, number_or_null
from ..runtime import durable, lookup_join


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def align(df: DataFrame, canonical: list[str], fill: Column | None = None) -> DataFrame:
    """Add missing columns as NULL, drop extra ones, fix the order."""
    fill = F.lit(None).cast("double") if fill is None else fill
    return df.select(*[F.col(f"`{c}`") if c in df.columns else fill.alias(c) for c in canonical])


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the columns of the first one."""
    canonical = frames[0].columns
    out = frames[0]
    for f in frames[1:]:
        shared = f.select(*[F.col(f"`{c}`") for c in f.columns if c in canonical])
        out = out.unionByName(shared, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in canonical])


def to_number(df: DataFrame, col: str) -> Column:
    """Finite double of a text or numeric column, else NULL."""
    c = F.col(f"`{col}`")
    kind = df.schema[col].dataType
    if isinstance(kind, StringType):
        return number_or_null(c)
    if isinstance(kind, NumericType):
        return finite_or_null(c.cast("double"))
    return F.lit(None).cast("double")


def clean_strict(df: DataFrame, features: list[str]) -> DataFrame:
    """Numbers or NULL; rows with any NULL feature are dropped."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in features]
    return df.select(*rest, *[to_number(df, c).alias(c) for c in features]).filter(
        reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in features]))


def numeric_columns(df: DataFrame, features: list[str]) -> list[str]:
    """Features with at least one number anywhere; one pass over the table."""
    seen = df.agg(*[F.count(to_number(df, c)).alias(f"n{i}") for i, c in enumerate(features)]).head()
    return [c for i, c in enumerate(features) if seen[f"n{i}"] > 0]


def clean_flexible(df: DataFrame, features: list[str], find: bool = True) -> DataFrame:
    """Numbers, else 0; columns without any number are dropped, all rows stay."""
    kept = numeric_columns(df, features) if find else features
    rest = [F.col(f"`{c}`") for c in df.columns if c not in features]
    return df.select(*rest, *[F.coalesce(to_number(df, c), F.lit(0.0)).alias(c) for c in kept])


def label_by_token(c: Column, benign: str, trim: bool = True) -> Column:
    """0 for the benign token, else 1; a missing label reads as the text 'nan', hence 1."""
    text = c.cast("string")
    text = F.trim(text) if trim else text
    return (F.coalesce(text, F.lit("nan")) != benign).cast("int")


def label_by_set(c: Column, benign: tuple[str, ...] = ("NORMAL", "BENIGN")) -> Column:
    return (~F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("nan")))).isin(*benign)).cast("int")


def first_present(columns: list[str], candidates: list[str]) -> str:
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"expected one of {candidates}, columns={columns}")


def label_mixed(df: DataFrame, col: str) -> Column:
    """0/1 text to int when the whole column is 0/1, else 'normal' (any case) against the rest."""
    text = F.trim(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("nan")))
    binary = df.agg(F.bool_and(text.isin("0", "1", "0.0", "1.0")).alias("b")).head()["b"]
    if binary:
        return F.when(text.isin("1", "1.0"), 1).otherwise(0)
    return (F.lower(text) != "normal").cast("int")


def encode_category(df: DataFrame, col: str, order: str, out: str | None = None) -> DataFrame:
    """Dense integer codes in first-seen order of ``order``; a missing value is the category 'nan'.

    First positions are minima combined before the shuffle; the way back is a salted lookup.
    """
    text = F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("nan"))
    first = durable(df.select(text.alias("_v"), F.col(order).alias("_o")).groupBy("_v").agg(
        F.min("_o").alias("_first")), "codes")
    codes = dense_rank_global(first, "_first", "_code").select("_v", F.col("_code").cast("int"))
    coded = lookup_join(df.withColumn("_v", text), codes, ["_v"], [order])
    return coded.withColumn(out or f"{col}_code", F.col("_code")).select(*df.columns, *(
        [out or f"{col}_code"] if (out or f"{col}_code") not in df.columns else []))


def row_accounting(df: DataFrame, keep: Column, label: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.count_if(keep).alias("kept"),
        F.count_if(~keep).alias("dropped"),
        F.count_if(keep & (F.col(label) == 1)).alias("positives"),
        F.count_if(keep & (F.col(label) == 0)).alias("negatives"))
