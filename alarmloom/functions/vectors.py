"""Feature arrays as unrolled scalar columns, so that arithmetic stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width(df: DataFrame, col: str = "features") -> int:
    """Length of the feature array (fixed within an alarm set)."""
    row = df.select(F.size(col).alias("d")).head()
    if row is None:
        raise ValueError("empty alarm set")
    return row["d"]


def names(dims: int, prefix: str = "f") -> list[str]:
    return [f"{prefix}{i}" for i in range(dims)]


def unroll(df: DataFrame, dims: int, col: str = "features", prefix: str = "f") -> DataFrame:
    rest = [c for c in df.columns if c != col]
    return df.selectExpr(*[f"`{c}`" for c in rest], *[f"{col}[{i}] AS {prefix}{i}" for i in range(dims)])


def squared_distance(left: list[str], right: list[str]) -> Column:
    """Sum of squared differences of two lists of SQL expressions, added from left to right."""
    return F.expr(" + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(left, right)))
