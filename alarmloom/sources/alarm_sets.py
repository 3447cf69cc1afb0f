"""Alarm sets: JSON in, experiment discovery, alarm and outcome exports, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import binary_metrics

ALARM_SCHEMA = "index long, features array<double>, y_true int, y_pred int"
# Placeholders of the outcome export.
PLACEHOLDER = {"saddr": "0.0.0.0", "daddr": "0.0.0.0", "start": 0.0, "end": 0.0, "len": 1, "loss": 0.0}
# Folders that ``save_experiments`` makes.
KEYED = r"dataset=([^/]+)/data_type=([^/]+)/model=([^/]+)/seed=(-?\d+)/[^/]*$"
LAYOUT = r"([^/]+)-([^-/]+)-([^-/]+)/(?:split_seed)*(-?\d+)/alert\.json(?:/[^/]*)?$"


def load_alarms(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Alarm rows of a JSON array file, or of JSON-lines output; sets without index get one."""
    df = spark.read.schema(ALARM_SCHEMA).option("multiLine", not lines).json(path)
    return df.withColumn("index", F.coalesce("index", F.monotonically_increasing_id()))


def discover_experiments(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, data_type, model, seed, tag, alert_path) from the directory layout; no file is read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    )
    keyed = F.col("path").rlike(KEYED)
    # characters that a folder cannot hold are percent-encoded in its name; a plus sign stands for itself
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    part = lambda i: F.when(keyed, plain(F.regexp_extract("path", KEYED, i))).otherwise(
        F.regexp_extract("path", LAYOUT, i))
    path = F.when(keyed, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.regexp_replace("path", r"(/alert\.json)/.*$", "$1"))
    return listed.filter(keyed | F.col("path").rlike(LAYOUT)).select(
        part(1).alias("dataset"), part(2).alias("data_type"), part(3).alias("model"),
        part(4).cast("int").alias("seed"), path.alias("alert_path"),
    ).distinct().withColumn("tag", tag_of()).orderBy("dataset", "data_type", "model", "seed")


def save_experiments(alarms: DataFrame, root: str, files: int = 16) -> None:
    """Alarm sets (dataset, data_type, model, seed, ...) as JSON lines, all in one write.

    The rows of a set go to ``files`` files by a hash of their index, so that a set with most of the rows is not one task; ``root`` gets a folder
    dataset=/data_type=/model=/seed= for each set, which ``discover_experiments`` reads like its own layout.
    """
    spread = F.pmod(F.xxhash64("index"), F.lit(files))
    keys = ["dataset", "data_type", "model", "seed"]
    alarms.repartition(*keys, spread).write.partitionBy(*keys).json(root)


def tag_of():
    return F.concat_ws("-", "dataset", "data_type", "model", F.concat(F.lit("seed"), "seed"))


def alarm_records(pred: DataFrame, pos: int = 1) -> DataFrame:
    return pred.filter(F.col("y_pred") == pos).select("index", "features", "y_true", "y_pred")


def save_alarms(pred: DataFrame, path: str, pos: int = 1) -> None:
    """One JSON object per line in a folder, written in parallel."""
    alarm_records(pred, pos).write.mode("overwrite").json(path)


def alarm_summary(pred: DataFrame, model: str, classifier: str, pos: int = 1) -> DataFrame:
    m = binary_metrics(pred, pos)
    alerts = F.col("tp") + F.col("fp")
    return m.select(
        F.lit(model).alias("model_name"), F.lit(classifier).alias("classifier_name"),
        F.lit(pos).alias("pos_label"),
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("num_test_samples"),
        alerts.alias("num_alerts"), F.col("tp").alias("num_tp"), F.col("fp").alias("num_fp"),
        F.when(alerts > 0, F.col("fp") / alerts).alias("fp_share"),
        "accuracy", "precision", "recall", "tpr", "fpr", "f1", "tn", "fn")


def outcome_records(pred: DataFrame, pos: int = 1) -> DataFrame:
    """Rows with outcome FP/TP/FN/TN; only alarms keep their features."""
    t, p = F.col("y_true") == pos, F.col("y_pred") == pos
    outcome = F.when(p & t, "TP").when(p & ~t, "FP").when(~p & t, "FN").otherwise("TN")
    return pred.select(
        outcome.alias("outcome"), F.col("y_true").alias("code"),
        *[F.lit(v).alias(k) for k, v in PLACEHOLDER.items()],
        F.when(p, F.col("features")).alias("feature"), "index")


def save_outcomes(pred: DataFrame, path: str, pos: int = 1) -> None:
    """Folders outcome=FP|TP|FN|TN of JSON lines, one record per line."""
    outcome_records(pred, pos).drop("index").write.mode("overwrite").partitionBy("outcome").json(path)


def read_outcome_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of the nested {"result": [...]} form."""
    record = ("code:int, saddr:string, daddr:string, start:double, end:double, len:int, "
              "loss:double, feature:array<double>")
    nested = spark.read.schema(f"result array<struct<{record}>>").option("multiLine", True).json(path)
    return nested.select(F.explode("result").alias("r")).select("r.*")


# --- result tables -----------------------------------------------------------------------------------

def pending(experiments: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Experiments whose keys are not in the result table yet."""
    if done is None:
        return experiments
    return experiments.join(done.select(*keys).distinct(), keys, "left_anti")


def reuse_rows(runs: DataFrame, prior: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Ablation runs with the metrics of an earlier result table where it has them."""
    return runs.join(prior.select(*keys, *cols), keys, "left")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) else None


def save_curve(curve: DataFrame, path: str) -> None:
    curve.write.mode("overwrite").option("header", True).csv(path)
