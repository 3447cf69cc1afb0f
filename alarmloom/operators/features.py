"""Feature scaling, selection and bit encoding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import quantiles, running_totals
from ..functions.scalars import finite_or_null, finite_or_zero
from ..functions.vectors import width
from ..runtime import durable


def per_dim(df: DataFrame, aggs: list, col: str = "features") -> list:
    """Aggregates of every dimension as (dim, ...) rows: D rows, combined before the shuffle.

    One row per (alarm, dim) keeps the generated code small for any number of dimensions.
    """
    rows = exploded(df, [], col).groupBy("dim").agg(*aggs).collect()
    return sorted(rows, key=lambda r: r["dim"])


def minmax_log_fit(df: DataFrame, col: str = "features") -> list[tuple[float, float]]:
    """(min, max) of each dimension after non-finite values became 0."""
    x = finite_or_zero(F.col("value"))
    return [(r["lo"], r["hi"]) for r in per_dim(df, [F.min(x).alias("lo"), F.max(x).alias("hi")], col)]


def minmax_log(
    df: DataFrame, col: str = "features", fitted: list[tuple[float, float]] | None = None
) -> DataFrame:
    """Non-finite to 0, min-max to [0, 1], then log2(1 + x).

    Fitted on the rows themselves, or with ``fitted`` ranges from elsewhere, which need clipping.
    """
    clip = fitted is not None
    fitted = fitted or minmax_log_fit(df, col)
    rest = [c for c in df.columns if c != col]
    cells = []
    for i, (lo, hi) in enumerate(fitted):
        x = f"{col}[{i}]"
        # NaN and infinities fail the comparison, NULL leaves it undecided: all become 0
        scaled = f"(if(abs({x}) <= 1.7976931348623157E308D, {x}, 0D) - ({lo!r}D)) / {(hi - lo) or 1.0!r}D"
        cells.append(f"log2(1D + greatest(0D, least(1D, {scaled})))" if clip else f"log2(1D + {scaled})")
    return df.select(*rest, F.expr(f"array({', '.join(cells)})").alias(col))


def top_variance_dims(df: DataFrame, k: int = 20, col: str = "features") -> list[int]:
    """Dimensions by descending population variance, lower dimension first on ties."""
    var = {r["dim"]: r["v"] for r in per_dim(df, [F.var_pop("value").alias("v")], col)}
    return sorted(var, key=lambda i: (-var[i], i))[:k]


def keep_dims(df: DataFrame, dims: list[int], col: str = "features") -> DataFrame:
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.expr(f"array({', '.join(f'{col}[{i}]' for i in dims)})").alias(col))


def exploded(df: DataFrame, keep: list[str], col: str = "features") -> DataFrame:
    """One row per (alarm, dim)."""
    return df.select(*keep, F.posexplode(col).alias("dim", "value"))


def ks_statistics(df: DataFrame, label: str = "y_true", col: str = "features") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of label 0 against label 1, per dimension."""
    counts = durable(
        exploded(df, [label], col).groupBy("dim", "value").agg(
            F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
        ),
        "ks",
    )
    cum = running_totals(counts, "value", {"n0": "c0", "n1": "c1"}, ["dim"])
    totals = counts.groupBy("dim").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    # c = rows at or above the value, so t - c + n counts the rows at or below it
    below0 = (F.col("t0") - F.col("c0") + F.col("n0")) / F.col("t0")
    below1 = (F.col("t1") - F.col("c1") + F.col("n1")) / F.col("t1")
    return cum.join(F.broadcast(totals), "dim").groupBy("dim").agg(
        F.max(F.abs(below0 - below1)).alias("ks")
    )


def top_ks_dims(df: DataFrame, k: int = 20, label: str = "y_true", min_rows: int = 5) -> list[int]:
    n = df.agg(
        F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")
    ).head()
    dims = width(df)
    if n["a"] < min_rows or n["b"] < min_rows:
        return list(range(dims))
    stats = {r["dim"]: r["ks"] for r in ks_statistics(df, label).collect()}
    return sorted(range(dims), key=lambda i: (-stats[i], i))[:k]


def _median(df: DataFrame) -> float | None:
    return quantiles(df, "x", [0.5])[0]


def robust_z(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    """0.6745 (x - median) / MAD; NaN is ignored by the medians, MAD below 1e-12 counts as 1; without a finite value NaN."""
    x = finite_or_null(F.col(value))
    clean = df.select(x.alias("x"))
    med = _median(clean)
    if med is None:  # no finite value
        return df.withColumn(out, F.lit(float("nan")))
    mad = _median(clean.select(F.abs(F.col("x") - F.lit(med)).alias("x")))
    mad = mad if mad > 1e-12 else 1.0
    return df.withColumn(out, F.lit(0.6745) * (F.col(value) - F.lit(med)) / F.lit(mad))


def standardize_fit(df: DataFrame, col: str = "features") -> list[tuple[float, float]]:
    rows = per_dim(df, [F.avg("value").alias("m"), F.stddev_pop("value").alias("s")], col)
    return [(r["m"], r["s"] or 1.0) for r in rows]


def standardize(df: DataFrame, fitted: list[tuple[float, float]], col: str = "features") -> DataFrame:
    rest = [c for c in df.columns if c != col]
    cells = [f"({col}[{i}] - ({m!r}D)) / {s!r}D" for i, (m, s) in enumerate(fitted)]
    return df.select(*rest, F.expr(f"array({', '.join(cells)})").alias(col))


# --- bit encoding -----------------------------------------------------------------------------

# The 20 named inputs of the bit encoder with their widths, in input order.
BIT_WIDTHS = {
    "dur": 8, "proto": 8, "sbytes": 16, "dbytes": 16, "sttl": 8, "dttl": 8, "sload": 24,
    "dload": 24, "spkts": 16, "dpkts": 16, "smean": 16, "dmean": 16, "sinpkt": 16, "dinpkt": 16,
    "tcprtt": 8, "synack": 8, "ackdat": 8, "ct_src_ltm": 8, "ct_dst_ltm": 8, "ct_dst_src_ltm": 8,
}
# Inputs counted in thousands.
SCALED_INPUTS = ("sbytes", "dbytes", "sload", "dload")
# Other spellings of an input name.
INPUT_ALIASES = {
    "smean": ["smeansz"], "dmean": ["dmeansz"], "sinpkt": ["sintpkt"], "dinpkt": ["dintpkt"],
    "ct_src_ltm": ["ctsrcltm"],
}
# Width by words in the column name, first match wins; 16 otherwise.
WIDTH_BY_WORD = [
    (8, ("ttl", "flag", "proto", "state")),
    (16, ("duration", "dur", "iat", "pkt", "packet")),
    (24, ("byte", "load", "rate", "window")),
]
NAMED_PROFILE_DATASETS = ("unswnb15",)
GENERIC_PROFILE_DATASETS = ("ids2017", "kdd", "malicioustls")


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", str(name).strip().lower())


def bit_profile(dataset: str, columns: list[str]) -> list[tuple[int, int, bool]]:
    """(column position, bit width, counted in thousands) for each encoder input."""
    ds = plain_name(dataset)
    if ds in NAMED_PROFILE_DATASETS:
        at = {plain_name(c): i for i, c in enumerate(columns)}
        found, missing = [], []
        for name, bits in BIT_WIDTHS.items():
            spellings = [plain_name(s) for s in [name, *INPUT_ALIASES.get(name, [])]]
            hit = next((at[s] for s in spellings if s in at), None)
            if hit is None:
                missing.append(name)
            else:
                found.append((hit, bits, name in SCALED_INPUTS))
        if missing:
            raise ValueError(f"missing encoder inputs: {missing}")
        return found
    if ds in GENERIC_PROFILE_DATASETS:
        if len(columns) < 20:
            raise ValueError(f"the bit encoder needs 20 columns, got {len(columns)}")
        out = []
        for i, c in enumerate(columns[:20]):
            low = c.lower()
            bits = next((b for b, words in WIDTH_BY_WORD if any(w in low for w in words)), 16)
            out.append((i, bits, "byte" in low or "load" in low))
        return out
    raise ValueError(f"no bit profile for dataset {dataset!r}")


def bit_encode(
    df: DataFrame, profile: list[tuple[int, int, bool]], col: str = "features", out: str = "bits"
) -> DataFrame:
    """Most significant bit first, 0 written as -1; one expression per input.

    Values beyond the width, and beyond any integer, count as the largest value of that width.
    """
    ints = []
    for i, (pos, width_, thousands) in enumerate(profile):
        whole = finite_or_zero(F.col(col)[pos])
        if thousands:
            whole = whole / F.lit(1000.0)
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(float((1 << width_) - 1)), whole))
        ints.append(clipped.cast("int").alias(f"_i{i}"))

    def digits(i: int, width_: int) -> Column:
        places = F.sequence(F.lit(width_ - 1), F.lit(0), F.lit(-1))
        bit = lambda at: F.call_function("shiftright", F.col(f"_i{i}"), at).bitwiseAND(F.lit(1))
        return F.transform(places, lambda at: (bit(at) * 2 - 1).cast("tinyint"))

    bits = [digits(i, width_) for i, (_, width_, _) in enumerate(profile)]
    return df.select("*", *ints).withColumn(out, F.flatten(F.array(*bits))).drop(*[f"_i{i}" for i in range(len(profile))])
