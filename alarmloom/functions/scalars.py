"""Column expressions: finite numbers, text to number, hashes for reproducible sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number; anything else (for example '1d' or '0x0b') is not one.
NUMERIC_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL: only a finite x has x - x = 0."""
    return F.when(c - c == F.lit(0.0), c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def number_or_null(c: Column) -> Column:
    """Text to a finite double; blanks, words and infinities become NULL."""
    t = F.trim(c)
    return F.when(t.rlike(NUMERIC_TEXT), finite_or_null(t.try_cast("double")))


def hash_key(seed: int, c: Column) -> Column:
    """md5 text that orders rows at random but reproducibly for a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_fraction(seed: int, c: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of ``hash_key``."""
    head = F.substring(hash_key(seed, c), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den, or ``empty`` when the denominator is zero."""
    q = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return q if empty is None else F.coalesce(q, F.lit(empty))


def min_max(c: Column, low: Column, high: Column, constant: float) -> Column:
    """(c - low) / (high - low), or ``constant`` when all values are equal."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(constant))
