"""Detector metrics, cluster summaries, thresholds and result summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import quantiles, running_totals
from ..functions.scalars import min_max, ratio
from ..runtime import durable

SORT_MODES = {
    "fp_ratio": ["fp_ratio", "fp_cnt", "size"],
    "fp_cnt": ["fp_cnt", "fp_ratio", "size"],
    "size": ["size", "fp_cnt", "fp_ratio"],
    "tp_cnt": ["tp_cnt", "neg_fp_ratio", "size"],
}


def false_positives(pred: DataFrame, pos: int = 1) -> DataFrame:
    return pred.filter((F.col("y_true") != pos) & (F.col("y_pred") == pos))


def false_positive_stats(pred: DataFrame, pos: int = 1) -> DataFrame:
    fp = (F.col("y_true") != pos) & (F.col("y_pred") == pos)
    return pred.agg(F.count("*").alias("num_samples"), F.count_if(fp).alias("num_fp")).select(
        "num_samples", "num_fp", ratio(F.col("num_fp"), F.col("num_samples")).alias("fp_rate"))


def label_counts(pred: DataFrame, label: str = "y_true") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def binary_metrics(pred: DataFrame, pos: int = 1, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn, accuracy, precision, recall, tpr, fpr, f1; zero denominators give 0."""
    t, p = F.col("y_true") == pos, F.col("y_pred") == pos
    c = pred.groupBy(*(by or [])).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    rates = c.select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"))
    return rates.withColumn("f1", ratio(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def cluster_fp_tp(labelled: DataFrame, benign: int = 0, pos: int = 1) -> DataFrame:
    """(cid, size, fp_cnt, tp_cnt, fp_ratio, tp_ratio) from (cid, y_true)."""
    return labelled.groupBy("cid").agg(
        F.count("*").alias("size"),
        F.count_if(F.col("y_true") == benign).alias("fp_cnt"),
        F.count_if(F.col("y_true") == pos).alias("tp_cnt"),
    ).select("*", (F.col("fp_cnt") / F.col("size")).alias("fp_ratio"),
             (F.col("tp_cnt") / F.col("size")).alias("tp_ratio"))


def cluster_summary(
    labelled: DataFrame, topn: int = 50, sort_by: str = "fp_ratio", benign: int = 0, pos: int = 1
) -> DataFrame:
    """The ``topn`` clusters of a sort mode with cumulative FP and TP coverage (a top-k report)."""
    if sort_by not in SORT_MODES:
        raise ValueError(f"unknown sort_by={sort_by}")
    per = durable(cluster_fp_tp(labelled, benign, pos), "summary")
    totals = per.agg(F.sum("fp_cnt").alias("f"), F.sum("tp_cnt").alias("t")).head()
    keys = [F.col(c).desc() for c in SORT_MODES[sort_by]] + [F.col("cid")]
    top = per.withColumn("neg_fp_ratio", -F.col("fp_ratio")).orderBy(*keys).limit(topn)
    order = Window.partitionBy(F.lit(0)).orderBy(*keys)  # at most topn rows
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.select(
        F.row_number().over(order).alias("pos"), "cid", "size", "fp_cnt", "tp_cnt", "fp_ratio",
        "tp_ratio",
        ratio(F.sum("fp_cnt").over(upto), F.lit(totals["f"] or 0)).alias("fp_cov"),
        ratio(F.sum("tp_cnt").over(upto), F.lit(totals["t"] or 0)).alias("tp_cov"))


# --- result tables ------------------------------------------------------------------------------------

def group_summary(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric per group and overall (keys NULL), one pass."""
    aggs = [F.count("*").alias("n_rows")]
    for m in metrics:
        c = F.col(f"`{m}`")
        aggs += [F.avg(c).alias(f"{m}_mean"), F.stddev_samp(c).alias(f"{m}_std")]
    sets = [[F.col(k) for k in keys], []]
    return results.groupingSets(sets, *keys).agg(*aggs, F.grouping(keys[0]).alias("overall"))


def best_method(results: DataFrame, keys: list[str], methods: list[tuple[str, str]]) -> DataFrame:
    """Method with the highest mean AUC per group; the first listed wins ties."""
    entries = F.explode(F.array(*[F.struct(
        F.lit(label).alias("method"), F.lit(i).alias("order"), F.col(f"`{col}`").alias("auc"))
        for i, (label, col) in enumerate(methods)]))
    mean = results.select(*keys, entries.alias("e")).groupBy(*keys, "e.method", "e.order").agg(
        F.avg("e.auc").alias("auc")).filter(F.col("auc").isNotNull())
    return mean.groupBy(*keys).agg(
        F.max_by(F.struct("method", "auc"), F.struct(F.col("auc"), -F.col("order"))).alias("b")
    ).select(*keys, F.col("b.method").alias("best_method"), F.col("b.auc").alias("best_auc"))


# --- detector thresholds --------------------------------------------------------------------------------

def error_threshold(errors: DataFrame, q: float = 0.99, low: float = 0.9) -> DataFrame:
    """Quantile of the errors on normal rows (all rows if there are none), clamped; mean and std."""
    normal = errors.filter(F.col("y_true") == 0)
    if normal.isEmpty():
        normal = errors
    q = max(min(q, 0.9999), low)
    thr = quantiles(normal, "err", [q])[0]
    return normal.agg(F.avg("err").alias("error_mean"), F.stddev_pop("err").alias("error_std")
                      ).withColumn("threshold", F.lit(thr))


def quantile_threshold(errors: DataFrame, q: float = 0.95) -> DataFrame:
    """Label-free threshold: q clamped to [0.5, 0.9999] over all rows."""
    return error_threshold(errors.withColumn("y_true", F.lit(0)), q, 0.5)


def accuracy_threshold(errors: DataFrame) -> DataFrame:
    """Threshold (err >= thr is positive) that maximises accuracy; the highest wins ties."""
    per = durable(errors.groupBy(F.col("err").alias("threshold")).agg(
        F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("n")),
        "roc")
    t = per.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).head()
    cum = running_totals(per, "threshold", {"p": "tp", "n": "fp"})
    tpr = ratio(F.col("tp"), F.lit(t["p"]))
    fpr = ratio(F.col("fp"), F.lit(t["n"]))
    share = t["p"] / (t["p"] + t["n"])
    acc = tpr * F.lit(share) + (F.lit(1.0) - fpr) * F.lit(1.0 - share)
    row = F.struct("threshold", acc.alias("acc"), tpr.alias("tpr"), fpr.alias("fpr"))
    return cum.agg(F.max_by(row, F.struct(F.round(acc, 12), F.col("threshold"))).alias("b")).select("b.*")


def anomaly_probability(errors: DataFrame) -> DataFrame:
    """Add proba_neg and proba_pos: min-max normalised error, constant errors give 0."""
    lo, hi = errors.agg(F.min("err"), F.max("err")).head()
    pos = min_max(F.col("err"), F.lit(lo), F.lit(hi), 0.0)
    return errors.withColumn("proba_pos", pos).withColumn("proba_neg", F.lit(1.0) - F.col("proba_pos"))
