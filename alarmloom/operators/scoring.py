"""Unsupervised cluster scores, alarm scores and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import min_max
from ..runtime import lookup_join

# The rule pool in the order in which ties are resolved.
RULES = [
    "intra_high", "intra_low", "kdist_high", "kdist_low", "size_small", "size_large",
    "compact_high", "compact_low", "isolation_high", "isolation_low", "combined_fwd",
    "combined_inv",
]
# Directions that turn a signal around.
INVERTED = {"density": "low", "intra": "low", "kdist": "low", "size": "small", "compact": "low",
            "isolation": "low", "combined": "inv"}


def _raw_signal(signal: str, kdist: bool) -> Column:
    size = F.col("size").cast("double")
    intra = F.col("avg_intra_dist")
    if signal == "density":
        return F.col("density_size")
    if signal == "intra":
        return intra
    if signal == "kdist":
        return F.col("avg_kdist") if kdist else F.lit(0.0)
    if signal == "size":
        return size
    if signal == "compact":
        return size / (intra * F.log1p(size) + F.lit(1e-10))
    if signal == "isolation":
        return (F.col("avg_kdist") if kdist else F.lit(1.0)) / (intra + F.lit(1e-10))
    raise ValueError(f"unknown scoring rule signal: {signal}")


def score_clusters(
    profiles: DataFrame, rules: list[str] | None = None, by: list[str] | None = None,
    kdist: bool = True,
) -> DataFrame:
    """(by, cid, size, rule, score): every rule of the pool in one pass, as rows."""
    by = by or ["run"]
    # minima and maxima per run are combined before they meet the profile rows again
    signals = sorted({r.rpartition("_")[0] for r in (rules or RULES)})
    for s in signals:
        if s not in INVERTED:
            raise ValueError(f"unknown scoring rule signal: {s}")
    plain = sorted({x for s in signals for x in (("intra", "kdist") if s == "combined" else (s,))})
    raw = profiles.select(*by, "cid", "size", *[_raw_signal(s, kdist).alias(f"x_{s}") for s in plain])
    ends = raw.groupBy(*by).agg(*[g for s in plain for g in (
        F.min(f"x_{s}").alias(f"lo_{s}"), F.max(f"x_{s}").alias(f"hi_{s}"))])
    wide = raw.join(F.broadcast(ends), by)

    def scaled(s):
        return min_max(F.col(f"x_{s}"), F.col(f"lo_{s}"), F.col(f"hi_{s}"), 0.5)

    entries = []
    for rule in rules or RULES:
        signal, _, direction = rule.rpartition("_")
        if signal == "combined":
            score = (scaled("intra") + scaled("kdist")) / F.lit(2.0) if kdist else scaled("intra")
        else:
            score = scaled(signal)
        score = F.lit(1.0) - score if direction == INVERTED[signal] else score
        entries.append(F.struct(F.lit(rule).alias("rule"), score.alias("score")))
    return wide.select(*by, "cid", "size", F.explode(F.array(*entries)).alias("e")).select(
        *by, "cid", "size", "e.rule", "e.score")


MIN_CLUSTER_SIZE = 5


def effective_score(min_cluster_size: int = MIN_CLUSTER_SIZE) -> Column:
    """The score that the alarms of a cluster get: small clusters count 0."""
    return F.when(F.col("size") >= min_cluster_size, F.col("score")).otherwise(0.0)


def alarm_scores(
    membership: DataFrame, scored: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE,
    by: list[str] | None = None,
) -> DataFrame:
    """(by, rule, id, cid, score): the score of the alarm's cluster; small or unknown clusters 0."""
    by = by or ["run"]
    rules = scored.groupBy(*by, "cid").agg(F.collect_list(F.struct(
        "rule", effective_score(min_cluster_size).alias("score"))).alias("rules"))  # one entry per rule
    found = lookup_join(membership.select(*by, "id", "cid"), rules, [*by, "cid"], ["id"], "left")
    return found.select(*by, "id", "cid", F.explode_outer("rules").alias("r")).select(
        *by, "id", "cid", "r.rule", F.coalesce("r.score", F.lit(0.0)).alias("score"))


def blended(
    scores: DataFrame, kdist: DataFrame, blends: list[float], by: list[str] | None = None
) -> DataFrame:
    """(..., blend, score) with score = (1 - b) score + b minmax(kdist); constant kdist counts 0."""
    by = by or ["run"]
    shared = [c for c in by if c in kdist.columns]
    ends = kdist.groupBy(*shared).agg(F.min("kdist").alias("lo"), F.max("kdist").alias("hi"))
    outlier = kdist.join(F.broadcast(ends), shared) if shared else kdist.withColumns(
        dict(zip(("lo", "hi"), map(F.lit, ends.head()))))
    outlier = outlier.select(
        *shared, "id", min_max(F.col("kdist"), F.col("lo"), F.col("hi"), 0.0).alias("_out"))
    b = F.explode(F.array(*[F.lit(float(x)) for x in blends])).alias("blend")
    rows = scores.join(outlier, [*shared, "id"]).select("*", b)
    mixed = (F.lit(1.0) - F.col("blend")) * F.col("score") + F.col("blend") * F.col("_out")
    return rows.withColumn("score", F.when(F.col("blend") > 0, mixed).otherwise(F.col("score"))).drop("_out")


def fp_ratio_scores(
    membership: DataFrame, labels: DataFrame, min_cluster_size: int = 1, benign: int = 0
) -> DataFrame:
    """(run, id, cid, score): share of benign rows in the alarm's cluster; small clusters 0."""
    rows = membership.join(labels.select("id", "y_true"), "id")
    per = rows.groupBy("run", "cid").agg(
        F.count("*").alias("size"), F.count_if(F.col("y_true") == benign).alias("fp"))
    ratio = F.when(F.col("size") >= min_cluster_size, F.col("fp") / F.col("size")).otherwise(0.0)
    return lookup_join(membership, per.select("run", "cid", ratio.alias("score")),
                       ["run", "cid"], ["id"], "left").select("run", "id", "cid", "score")

