"""Toxicity by weak supervision.

Voters are a lexicon of insults and word beginnings of three to nine letters that labelled texts suggest; a voter speaks up
where a text holds such a word. A generative label model takes the given label as one more voter and
estimates, by expectation maximisation, how often each voter speaks up in toxic and in clean texts; voters whose
votes are correlated beyond what the class explains share their weight. A linear classifier (logistic
regression on the votes) is then trained on the posterior labels and scores every text.

The fit reads a bounded sample: the labelled rows outside the held-out part whose hash falls below a limit, about
``SAMPLE_ROWS`` of them. Labels, languages, sources and ids are no inputs of a score. Null texts are empty and are scored; null labels and
ids teach nothing; of conflicting labels the larger counts; without any toxic label the lexicon alone votes, with fixed
weights; repeated rows get equal scores; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import durable
from .common import col, fresh, tune

SAMPLE_ROWS = 20_000
MOST_VOTERS = 400
LEAST_TEXTS = 4
# Lower end of the (Wilson) interval of a beginning's share of toxic texts, at so many standard deviations.
LEAST_PRECISION = 0.45
DEVIATIONS = 2.58
BEGINNINGS = range(3, 10)
THRESHOLD = 0.3
# Words that insult in themselves.
LEXICON = ["clown", "creep", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron",
           "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]
_WORDS = re.compile(r"[^\W\d_]{3,}")


class Model(NamedTuple):
    """Weights of the voters (``=word`` or ``beginning*``) and the intercept."""

    weights: dict[str, float]
    intercept: float


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def marks(word: str) -> list[str]:
    """Names of the voters that a word could belong to."""
    return [f"={word}", *[f"{word[:n]}*" for n in BEGINNINGS if n <= len(word)]]


class Votes:
    """Voters that speak up in a text; the voters of a word are remembered, for a bounded number of words."""

    def __init__(self, voters: list[str], limit: int = 300_000):
        self.index = {v: i for i, v in enumerate(voters)}
        self.limit, self.known = limit, {}

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        known = self.known
        for w in set(_WORDS.findall(text.lower())):
            got = known.get(w)
            if got is None:
                if len(known) >= self.limit:
                    known.clear()
                got = known[w] = tuple(self.index[m] for m in marks(w) if m in self.index)
            if got:
                out.update(got)
        return out


def _beginnings(batches):
    """(mark, n, k): texts and toxic texts with a word beginning, added up by batch."""
    from collections import Counter

    import pyarrow as pa

    for b in batches:
        n, k = Counter(), Counter()
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = {m for w in set(_WORDS.findall(text.lower())) for m in marks(w)[1:]}
            n.update(found)
            if label:
                k.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
                                          pa.array([k[m] for m in n], pa.int64())], ["mark", "n", "k"])


def precision_bound(k: Column, n: Column) -> Column:
    p, z2 = k / n, DEVIATIONS**2
    return (p + z2 / (2 * n) - DEVIATIONS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def label_model(
    votes: np.ndarray, given: np.ndarray, weight: np.ndarray | None = None, rounds: int = 50
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rates in toxic texts, rates in clean texts) of binary votes; ``given`` is one more voter, and
    ``weight`` the number of texts that a row stands for."""
    v = np.column_stack([votes, given]).astype(np.float64)
    n = np.ones(len(v)) if weight is None else weight.astype(np.float64)
    share, share_last = np.ones(v.shape[1]), np.zeros(v.shape[1])
    q = np.where(given > 0, 0.95, 0.02)
    for step in range(rounds):
        yes, no = q * n, (1 - q) * n
        hi = (yes @ v + 0.1) / (yes.sum() + 1.0)
        lo = (no @ v + 0.01) / (no.sum() + 1.0)
        prior = (yes.sum() + 0.5) / (n.sum() + 1.0)
        hi, lo = np.clip(hi, 1e-6, 1 - 1e-6), np.clip(lo, 1e-6, 1 - 1e-6)
        if step % 5 == 0 and np.abs(share - share_last).max() > 1e-3:
            rest = v - np.outer(q, hi) - np.outer(1 - q, lo)
            cov = (rest * n[:, None]).T @ rest / n.sum()
            sd = np.sqrt(np.diag(cov)) + 1e-9
            corr = cov / np.outer(sd, sd)
            np.fill_diagonal(corr, 0.0)
            share_last, share = share, 1.0 / (1.0 + np.where(corr > 0.2, corr, 0.0).sum(1))
        odds = math.log(prior / (1 - prior)) + v @ (share * np.log(hi / lo)) + (1 - v) @ (share * np.log((1 - hi) / (1 - lo)))
        new = 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40)))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-5:
            break
    return q, hi[:-1], lo[:-1]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    tune(spark)
    lexicon = [f"={w}" for w in LEXICON]
    fallback = Model({w: 5.0 for w in lexicon}, -4.0)
    known = labels.select(col(id_col).cast("long").alias("rid"), col(label_col).cast("int").alias("toxic")).filter(
        F.col("rid").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("rid"))).groupBy("rid").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = min(1.0, sample_rows / max(n, 1))
    picked = known.filter(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int(part * (1 << 20)))
    texts = docs.select(col(id_col).cast("long").alias("rid"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    # repeated rows of a document teach once
    sample = durable(texts.join(F.broadcast(picked), "rid").dropDuplicates(["rid"]), "toxic")
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).head()
    if not seen["n"] or not seen["k"] or seen["k"] == seen["n"]:
        return fallback

    counted = sample.select("text", "toxic").mapInArrow(_beginnings, "mark string, n long, k long").groupBy("mark").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k")).filter(F.col("k") >= LEAST_TEXTS)
    worth = precision_bound(F.col("k"), F.col("n"))
    best = counted.filter(worth >= LEAST_PRECISION).orderBy((worth * F.log(F.col("k") + 1)).desc(), "mark").limit(MOST_VOTERS)
    voters = lexicon + [r["mark"] for r in best.collect()]

    def votes(batches):
        import pyarrow as pa

        speak = Votes(voters)
        for b in batches:
            hits = [sorted(speak(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int32()))], ["toxic", "hits"])

    # texts with the same votes are one row with a weight; most have none
    cast = sample.select("toxic", "text").mapInArrow(votes, "toxic int, hits array<int>")
    rows = cast.groupBy("toxic", "hits").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "hits").collect()
    dense = np.zeros((len(rows), len(voters)))
    for i, r in enumerate(rows):
        dense[i, r["hits"]] = 1.0
    count = np.array([r["n"] for r in rows], np.float64)
    posterior, _, _ = label_model(dense, np.array([r["toxic"] for r in rows]), count)
    return _classifier(spark, [r["hits"] for r in rows], count, posterior, voters)


def _classifier(spark: SparkSession, hits: list[list[int]], count: np.ndarray, posterior: np.ndarray, voters: list[str]) -> Model:
    """Logistic regression on the votes; a text counts for each class with that class's posterior."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    size = len(voters)
    rows = [(Vectors.sparse(size, h, [1.0] * len(h)), y, float(n * (p if y else 1 - p)))
            for h, n, p in zip(hits, count, posterior) for y in (1.0, 0.0)]
    train = spark.createDataFrame([r for r in rows if r[2] > 1e-6], ["features", "label", "weight"])
    lr = LogisticRegression(weightCol="weight", regParam=1e-5, standardization=False, maxIter=60).fit(train)
    return Model(dict(zip(voters, map(float, lr.coefficients))), float(lr.intercept))


class _Score:
    def __init__(self, model: Model, at: int, name: str):
        self.model, self.at, self.name = model, at, name

    def __call__(self, batches):
        import pyarrow as pa

        speak, w = Votes(list(self.model.weights)), list(self.model.weights.values())
        for b in batches:
            odds = [self.model.intercept + sum(w[i] for i in sorted(speak(t or ""))) for t in b.column(self.at).to_pylist()]
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(odds, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, self.name])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` and the score, and the score's name: ``score`` or, where taken, with underscores before it."""
    from pyspark.sql import types as T

    tune(docs.sparkSession)
    (name,) = fresh(docs.columns, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_Score(model, docs.columns.index(text_col), name), schema), name
