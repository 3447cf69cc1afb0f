import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from alarmloom.llm import queries, toxicity


def split(ident):
    return zlib.crc32(str(ident).encode()) % 4 == 2


def corpus(spark, n=1600, seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("bdfgklmnprstvz", k=1) + rnd.choices("aeiou", k=1) + rnd.choices("lmnrst", k=2)) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(20, 80))
        toxic = int(rnd.random() < 0.15)
        if toxic:
            bad = ["idiot", "scum"] if i % 2 else ["grumpfel" + x for x in ("os", "en", "ix")]
            for w in rnd.choices(bad, k=4):
                words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    # labels of the held-out part are turned over: they must not be looked at
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    out, score = toxicity.score(docs, toxicity.fit(docs, turned))
    rows = [(truth[r["doc_id"]], r[score] >= toxicity.THRESHOLD) for r in out.collect() if split(r["doc_id"])]
    assert np.mean([t == p for t, p in rows]) > 0.97
    assert all(p for t, p in rows if t) or np.mean([p for t, p in rows if t]) > 0.9


def test_query_contract(spark, sf, documents):
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["held_out"] == split(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_label_model_weighs_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    vote = lambda hi, lo: (rng.random(4000) < np.where(y, hi, lo)).astype(float)
    good, bad = vote(0.7, 0.01), vote(0.3, 0.28)
    votes = np.column_stack([good, good, bad, vote(0.6, 0.02)])
    q, hi, lo = toxicity.label_model(votes, vote(0.9, 0.02))
    assert np.mean((q > 0.5) == y) > 0.95
    assert abs(hi[0] - 0.7) < 0.1 and lo[0] < 0.04 and abs(hi[2] - lo[2]) < 0.1


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1, "e"), (14, None, "e"), (14, 1, "e"), (14, 0, "e"), (8, 0, "e"), (9, 0, "e")], "doc_id long, toxic int, text string")
    for lab in (labels, labels.limit(0)):
        out, score = toxicity.score(odd_docs, toxicity.fit(odd_docs, lab))
        rows = out.collect()
        assert score == "_score" and out.columns == [*odd_docs.columns, score] and len(rows) == odd_docs.count()
        assert len({r[score] for r in rows if not r["text"]}) == 1
        insult = [r[score] for r in rows if r["doc_id"] == 14]
        assert insult[0] >= max(r[score] for r in rows)
    empty, _ = toxicity.score(no_docs, toxicity.fit(no_docs, labels))
    assert empty.count() == 0
