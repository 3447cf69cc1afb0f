"""Threshold curves, operating points and score transfer.

Every function takes ``by``: the keys that tell the evaluated scores apart (rule, run, blend ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import exact_quantile, quantiles, running_totals, value_counts
from ..functions.scalars import ratio
from ..runtime import durable, local_rows, lookup_join

RTPR_BUDGET = 0.10
MIN_RFPR = 0.3
RTPR_FLOOR = 0.02


def threshold_curve(
    scored: DataFrame, by: list[str] | None = None, benign: int = 0, pos: int = 1
) -> DataFrame:
    """One row per distinct score tau: rows at or above it are removed.

    Columns: by, tau, n_here, filtered_total, fp_removed, tp_removed, fp_total, tp_total, r_fpr,
    r_tpr, prev_fp, prev_tp. Groups without one of the classes yield no row.
    """
    by = by or []
    return counted_curve(scored.groupBy(*by, F.col("score").alias("tau")).agg(
        F.count("*").alias("n_here"),
        F.count_if(F.col("y_true") == benign).alias("fp_here"),
        F.count_if(F.col("y_true") == pos).alias("tp_here")), by)


def counted_curve(per: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``threshold_curve`` from counts: (by, tau, n_here, fp_here, tp_here), one row per score."""
    by = by or []
    per = durable(per, "curve")
    cum = running_totals(
        per, "tau", {"n_here": "filtered_total", "fp_here": "fp_removed", "tp_here": "tp_removed"},
        by)
    sums = [F.sum("fp_here").alias("fp_total"), F.sum("tp_here").alias("tp_total"),
            F.sum("n_here").alias("n_total")]
    if by:
        cum = lookup_join(cum, per.groupBy(*by).agg(*sums), by, ["tau"])
    else:
        t = per.agg(*sums).head()
        cum = cum.withColumns({k: F.lit(t[k]) for k in ("fp_total", "tp_total", "n_total")})
    return cum.filter((F.col("fp_total") > 0) & (F.col("tp_total") > 0)).select(
        *by, "tau", "n_here", "filtered_total", "fp_removed", "tp_removed", "fp_total",
        "tp_total", "n_total",
        (F.col("fp_removed") / F.col("fp_total")).alias("r_fpr"),
        (F.col("tp_removed") / F.col("tp_total")).alias("r_tpr"),
        ((F.col("fp_removed") - F.col("fp_here")) / F.col("fp_total")).alias("prev_fp"),
        ((F.col("tp_removed") - F.col("tp_here")) / F.col("tp_total")).alias("prev_tp"),
    )


def curve_auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trapezoid area over r_tpr with the corners (0,0) and (1,1); the curve ends in (1,1)."""
    piece = (F.col("r_tpr") - F.col("prev_tp")) * (F.col("r_fpr") + F.col("prev_fp")) / 2
    return curve.groupBy(*(by or [])).agg(F.sum(piece).alias("auc")).filter(F.col("auc").isNotNull())


def cer(r_fpr: Column, r_tpr: Column, floor: float = RTPR_FLOOR) -> Column:
    return r_fpr / F.greatest(r_tpr, F.lit(floor))


def operating_point(
    curve: DataFrame, by: list[str] | None = None, rtpr_budget: float | None = RTPR_BUDGET,
    min_rfpr: float = MIN_RFPR, rtpr_floor: float = RTPR_FLOOR,
) -> DataFrame:
    """(by, tau, r_fpr, r_tpr, fp_removed, tp_removed, quantile, CER, auc, source).

    Budget mode: best CER with r_tpr <= budget and r_fpr >= min_rfpr. ``rtpr_budget=None`` is the
    legacy mode: r_fpr >= min_rfpr and r_tpr >= floor. Fallbacks: best CER within the budget, then
    the largest r_fpr - r_tpr. The highest tau wins ties. One aggregate, no sorting.
    """
    by = by or []
    score = cer(F.col("r_fpr"), F.col("r_tpr"), rtpr_floor)
    if rtpr_budget is not None:
        ok = (F.col("r_tpr") <= rtpr_budget) & (F.col("r_fpr") >= min_rfpr)
        near = F.col("r_tpr") <= rtpr_budget
    else:
        ok = (F.col("r_fpr") >= min_rfpr) & (F.col("r_tpr") >= rtpr_floor)
        near = F.lit(False)
    row = F.struct("tau", "r_fpr", "r_tpr", "fp_removed", "tp_removed",
                   (F.col("filtered_total") / F.col("n_total")).alias("quantile"))
    profit = F.col("r_fpr") - F.col("r_tpr")
    rank = F.struct(score.alias("s"), F.col("tau"))
    piece = (F.col("r_tpr") - F.col("prev_tp")) * (F.col("r_fpr") + F.col("prev_fp")) / 2
    best = curve.groupBy(*by).agg(
        F.max_by(row, F.when(ok, rank)).alias("a"), F.max_by(row, F.when(near, rank)).alias("b"),
        F.max_by(row, F.struct(profit.alias("s"), F.col("tau"))).alias("c"),
        F.sum(piece).alias("auc"))
    pick = F.coalesce("a", "b", "c")
    return best.filter(pick.isNotNull()).select(
        *by, pick.alias("p"), "auc",
        F.when(F.col("a").isNotNull(), "constraints").when(F.col("b").isNotNull(), "budget")
        .otherwise("profit").alias("source"),
    ).select(*by, "p.*", cer(F.col("p.r_fpr"), F.col("p.r_tpr"), rtpr_floor).alias("CER"),
             "auc", "source")


def evaluate_at(
    scored: DataFrame, tau: DataFrame | float, by: list[str] | None = None, benign: int = 0,
    pos: int = 1,
) -> DataFrame:
    """Metrics at a transferred threshold; ``tau`` is a number or a (by, tau) table."""
    by = by or []
    rows = (scored.join(F.broadcast(tau.select(*by, "tau")), by) if isinstance(tau, DataFrame)
            else scored.withColumn("tau", F.lit(float(tau))))
    gone = F.col("score") >= F.col("tau")
    fp, tp = F.col("y_true") == benign, F.col("y_true") == pos
    agg = rows.groupBy(*by, "tau").agg(
        F.count_if(gone & fp).alias("fp_removed"), F.count_if(gone & tp).alias("tp_removed"),
        F.count_if(fp).alias("fp_total"), F.count_if(tp).alias("tp_total"))
    out = agg.select(
        *by, "tau", "fp_removed", "tp_removed",
        ratio(F.col("fp_removed"), F.col("fp_total"), None).alias("r_fpr"),
        ratio(F.col("tp_removed"), F.col("tp_total"), None).alias("r_tpr"))
    return out.withColumn("CER", cer(F.col("r_fpr"), F.col("r_tpr")))


def transfer_quantile(
    scored: DataFrame, q: DataFrame | float, by: list[str] | None = None
) -> DataFrame:
    """(by, tau): the score quantile 1 - q of this batch, q clamped to [1e-6, 1]."""
    by = by or []
    if not by and not isinstance(q, DataFrame):
        tau = quantiles(scored, "score", [1.0 - min(max(float(q), 1e-6), 1.0)])
        return local_rows(scored.sparkSession, [(t,) for t in tau if t is not None], "tau double")
    counted = value_counts(scored, "score", by)
    if isinstance(q, DataFrame):
        counted = counted.join(F.broadcast(q.select(*by, F.col("quantile").alias("_q"))), by)
        share = F.col("_q")
    else:
        share = F.lit(float(q))
    share = F.lit(1.0) - F.least(F.greatest(share, F.lit(1e-6)), F.lit(1.0))
    return exact_quantile(counted, share, by, "tau")


def points_at(
    scored: DataFrame, taus: list[float] = (0.9, 0.8, 0.7, 0.5), benign: int = 0, pos: int = 1
) -> DataFrame:
    """Counts at fixed thresholds in one pass; thresholds that remove nothing are left out."""
    fp, tp = F.col("y_true") == benign, F.col("y_true") == pos
    aggs = [F.count_if(fp).alias("fp_total"), F.count_if(tp).alias("tp_total")]
    for i, t in enumerate(taus):
        hit = F.col("score") >= t
        aggs += [F.count_if(hit & fp).alias(f"f{i}"), F.count_if(hit & tp).alias(f"t{i}"),
                 F.count_if(hit).alias(f"n{i}")]
    cells = F.explode(F.array(*[F.struct(
        F.lit(float(t)).alias("tau"), F.col(f"n{i}").alias("n"),
        (F.col(f"f{i}") / F.col("fp_total")).alias("r_fpr"),
        (F.col(f"t{i}") / F.col("tp_total")).alias("r_tpr")) for i, t in enumerate(taus)]))
    return scored.agg(*aggs).select(cells.alias("p")).select("p.*").filter(F.col("n") > 0)


def evaluate_scores(
    scored: DataFrame, by: list[str] | None = None, tau: DataFrame | float | None = None,
    quantile_tau: bool = False, rtpr_budget: float | None = RTPR_BUDGET,
) -> DataFrame:
    """Curve area plus the selected operating point, or the metrics at a transferred threshold.

    With ``quantile_tau`` the transferred number is a share of the scores, in both directions.
    """
    by = by or []
    curve = threshold_curve(scored, by)
    if tau is None:
        point = operating_point(curve, by, rtpr_budget)
        if quantile_tau:
            point = point.withColumn("abs_tau", F.col("tau")).withColumn("tau", F.col("quantile"))
        return point
    if quantile_tau:
        q = tau.withColumn("quantile", F.col("tau")) if isinstance(tau, DataFrame) else tau
        tau = transfer_quantile(scored, q, by)
        if not by:
            tau = tau.head()["tau"]
    at = evaluate_at(scored, tau, by)
    auc = curve_auc(curve, by)
    if by:
        return at.join(F.broadcast(auc), by)
    area = auc.head()
    if area is None:  # a class is missing: no curve, no metrics
        return at.withColumn("auc", F.lit(None).cast("double")).filter(F.lit(False))
    return at.withColumn("auc", F.lit(area["auc"]))
