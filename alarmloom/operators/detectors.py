"""Upstream detectors on pyspark.ml, one fit / predict interface for all of them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import width
from ..runtime import durable
from .features import bit_encode, bit_profile
from .metrics import anomaly_probability, error_threshold
from .sampling import train_test_split

MODELS = ("rf", "svm", "tree", "xgb", "ae", "n3ic")
SEED = 42
# Rows that are worth a task of their own in a fit, which passes over its rows dozens of times.
ROWS_PER_TASK = 50_000


def dealt(df: DataFrame, id_col: str = "index") -> DataFrame:
    """Training rows in even parts, one for each core at most, whatever files they come from.

    A table of one row group is read by one task, and a fit would keep to that task in every pass. Node statistics
    and gradients are sent once for each part, so that there are no more parts than cores. Rows are sorted within a
    part: draws by part and place do not depend on the order in which rows arrive.
    """
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    keys = [id_col, *[c for c in df.columns if c != id_col]]
    return df if parts <= 1 else df.repartition(parts, *keys).sortWithinPartitions(*keys)


def _vectors(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(col))).withColumn(
        "_y", F.col("y_true").cast("double"))


@dataclass
class Classifier:
    """A fitted pyspark.ml classifier behind predict()."""

    model: Any
    scaler: Any = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add y_pred, and y_score where the model yields probabilities."""
        x = _vectors(df)
        if self.scaler is not None:
            x = self.scaler.transform(x).drop("_v").withColumnRenamed("_s", "_v")
        out = self.model.transform(x)
        score = (vector_to_array("probability")[1] if "probability" in out.columns
                 else F.lit(None).cast("double"))
        return out.select(*df.columns, F.col("prediction").cast("int").alias("y_pred"),
                          score.alias("y_score"))


@dataclass
class ReconstructionDetector:
    """Linear autoencoder: standardise, project on the principal axes and back."""

    scaler: Any
    axes: Any
    threshold: float
    error_mean: float
    error_std: float

    def errors(self, df: DataFrame) -> DataFrame:
        """Add err: mean squared reconstruction error, larger is more anomalous.

        The axes are orthonormal, so it is what the projection lacks of the squared length."""
        x = self.axes.transform(self.scaler.transform(_vectors(df))).select(
            *df.columns, vector_to_array("_s").alias("_z"), vector_to_array("_p").alias("_c"))
        squared = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
        err = F.greatest(squared("_z") - squared("_c"), F.lit(0.0)) / F.size("_z")
        return x.select(*df.columns, err.alias("err"))

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.errors(df)
        flagged = scored.withColumn("y_pred", (F.col("err") > F.lit(self.threshold)).cast("int"))
        return anomaly_probability(flagged).select(
            *df.columns, "y_pred", F.col("proba_pos").alias("y_score"))


@dataclass
class BitDetector:
    """Bit-encoded inputs into a small perceptron; the better of a few epochs counts is kept."""

    profile: list
    model: Any
    accuracy: float

    def predict(self, df: DataFrame) -> DataFrame:
        bits = bit_encode(df, self.profile).withColumn("_b", F.col("bits").cast("array<double>"))
        out = self.model.transform(_vectors(bits, "_b"))
        return out.select(*df.columns, F.col("prediction").cast("int").alias("y_pred"),
                          vector_to_array("probability")[1].alias("y_score"))


def fit_reconstruction(df: DataFrame, components: int = 32, q: float = 0.99) -> ReconstructionDetector:
    """Fit on benign rows (all rows if there are none); threshold at the q quantile of their errors."""
    benign = df.filter(F.col("y_true") == 0)
    train = df if benign.isEmpty() else benign
    d = width(df)
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(_vectors(train))
    scaled = scaler.transform(_vectors(train))
    k = max(1, min(components, d - 1)) if d > 1 else 1
    axes = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    draft = ReconstructionDetector(scaler, axes, 0.0, 0.0, 0.0)
    stats = error_threshold(durable(draft.errors(df).select("y_true", "err"), "errors"), q).head()
    return ReconstructionDetector(scaler, axes, stats["threshold"], stats["error_mean"], stats["error_std"])


def fit_bits(
    df: DataFrame, dataset: str, columns: list[str], id_col: str = "index", val_size: float = 0.2,
    epochs: tuple[int, ...] = (15, 60), hidden: tuple[int, ...] = (64, 32), seed: int = 0,
) -> BitDetector:
    """Inner stratified validation chooses how long to train, as the best-epoch rule does."""
    profile = bit_profile(dataset, columns)
    rows = train_test_split(df.select(id_col, "y_true", "features"), "y_true", id_col, val_size, seed)
    cut = durable(bit_encode(dealt(rows, id_col), profile).select(
        id_col, "y_true", F.col("bits").cast("array<double>").alias("features"), "split"), "bits")
    train, val = _vectors(cut.filter("split = 'train'")), _vectors(cut.filter("split = 'test'"))
    judge = MulticlassClassificationEvaluator(
        labelCol="_y", predictionCol="prediction", metricName="accuracy")
    best = None
    for n in epochs:
        model = MultilayerPerceptronClassifier(
            layers=[sum(b for _, b, _ in profile), *hidden, 2], featuresCol="_v", labelCol="_y",
            maxIter=n, seed=seed, blockSize=128).fit(train)
        acc = judge.evaluate(model.transform(val))
        if best is None or acc > best[0]:
            best = (acc, model)
    return BitDetector(profile, best[1], best[0])


def fit_detector(
    kind: str, train: DataFrame, dataset: str | None = None, columns: list[str] | None = None,
    id_col: str = "index", **params,
):
    """Fit one of MODELS on (index, features, y_true); ``params`` override the defaults."""
    common = {"featuresCol": "_v", "labelCol": "_y"}
    x = _vectors(train if kind in ("ae", "n3ic") else dealt(train, id_col))
    if kind == "rf":
        # more memory for node statistics means fewer passes over the rows
        args = {"numTrees": 200, "seed": SEED, "maxDepth": 10, "maxMemoryInMB": 1024, **params}
        return Classifier(RandomForestClassifier(**common, **args).fit(x))
    if kind == "svm":
        scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(x)
        args = {"regParam": 1e-4, "maxIter": 20, "standardization": False, **params}
        scaled = scaler.transform(x).drop("_v").withColumnRenamed("_s", "_v")
        return Classifier(LinearSVC(**common, **args).fit(scaled), scaler)
    if kind == "tree":
        # the depth bound keeps the model small; pyspark.ml allows at most 30
        args = {"maxDepth": 20, "seed": SEED, **params}
        return Classifier(DecisionTreeClassifier(**common, **args).fit(x))
    if kind == "xgb":
        args = {"maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "maxIter": 500, "seed": SEED,
                "featureSubsetStrategy": "0.8", **params}
        return Classifier(GBTClassifier(**common, **args).fit(x))
    if kind == "ae":
        return fit_reconstruction(train, **params)
    if kind == "n3ic":
        if dataset is None or columns is None:
            raise ValueError("the bit detector needs the dataset name and the column names")
        return fit_bits(train, dataset, columns, id_col, **params)
    raise ValueError(f"unknown model {kind!r}, expected one of {MODELS}")
