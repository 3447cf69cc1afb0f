"""Alarm generation: split, fit, predict, keep the alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.detectors import fit_detector
from ..operators.metrics import binary_metrics, false_positive_stats
from ..operators.sampling import train_test_split
from ..runtime import durable
from ..sources.alarm_sets import alarm_summary, save_alarms, save_outcomes


def generate_alarms(
    data: DataFrame, model: str, test_size: float = 0.2, seed: int = 42, pos: int = 1,
    dataset: str | None = None, columns: list[str] | None = None, out_dir: str | None = None,
    **params,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions on the test split, metrics, false-positive stats); writes them below ``out_dir``.

    ``data`` is (index, features, y_true). Model "markers" stands for marker features of packet flows and uses boosted trees.
    """
    kind = "xgb" if model == "markers" else model
    cut = durable(train_test_split(
        data.select("index", "features", "y_true"), "y_true", "index", test_size, seed), "cut")
    train = cut.filter("split = 'train'").drop("split")
    test = cut.filter("split = 'test'").drop("split")
    fitted = fit_detector(kind, train, dataset, columns, **params)
    pred = durable(fitted.predict(test), "pred")
    if out_dir:
        save_alarms(pred, f"{out_dir}/alert.json", pos)
        alarm_summary(pred, model, kind, pos).write.mode("overwrite").json(f"{out_dir}/metrics")
        save_outcomes(pred, f"{out_dir}/outcomes", pos)
    return pred, binary_metrics(pred, pos), false_positive_stats(pred, pos)
