import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from alarmloom.llm import queries, rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def stats(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k + d for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(hit)


def failed(s):
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


def test_query_statistics(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = queries.op10_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = stats(texts[r["doc_id"]])
        assert tuple(r[c] for c in rules.STATS) == want and r["base_failed"] == failed(want)
        assert not (r["base_failed"] and r["kept"])


def test_odd_rows(odd_docs, no_docs):
    rows = rules.quality_rules(odd_docs, ["doc_id", "text", "kept"], out="q_").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert tuple(r[f"q_{c}"] for c in rules.STATS) == stats(r["text"])
    assert rules.quality_rules(no_docs, ["doc_id"]).count() == 0


def test_short_texts_with_overlapping_windows(spark):
    texts = ["a a a", "a a a a", "a a a a a", "a b a b a", "a b a b a b", "x a b c a b c y", "a b c d a b c e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", rules.text_stats(F.col("text")).alias("s"))
    for r in df.collect():
        assert tuple(r["s"]) == stats(r["text"])


def test_distance_against_numpy(spark):
    """The distance of every row follows from location and scatter of its group, and outliers do not move them."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2000, 5)) * [1, 0.5, 0.1, 0.2, 0.3] + [6, 1.6, 0, 0.1, 0]
    x[:300] += [0, 0, 5, 0, 4]
    df = spark.createDataFrame([("all", i, *map(float, r)) for i, r in enumerate(x)], "g string, id long, x0 double, x1 double, x2 double, x3 double, x4 double")
    e = rules.robust_scatter(df).head()
    centre = np.array([e[f"m{i}"] for i in range(5)])
    w = np.array([[e[f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    d = (((x - centre) @ w.T) ** 2).sum(1)
    core = x[np.argsort(d)[: int(0.75 * len(x)) + 20]]
    cov = np.cov(core.T, bias=True) * rules.CONSISTENCY + np.diag(np.array(rules.FLOORS) ** 2)
    want = np.einsum("ni,ij,nj->n", x - core.mean(0), np.linalg.inv(cov), x - core.mean(0))
    assert np.abs(centre - [6, 1.6, 0, 0.1, 0]).max() < 0.1
    assert np.allclose(d[300:], want[300:], rtol=0.1, atol=0.1)
    assert d[:300].min() > rules.CUT > d[300:].max()


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("aeiourstlnm"), rng.integers(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(900):
        words = list(rng.choice(vocab, rng.integers(60, 900)))
        if i % 10 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None, f"s{i % 2}"))
    out = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in out.collect())


def test_default_names_that_clash(spark, odd_docs):
    taken = odd_docs.withColumnsRenamed({"key": "N_Symbols", "shard": "distance", "slot": "rowid", "score": "g0", "rid": "base_failed"})
    for df in (taken, taken.withColumn("_kept", F.lit("mine"))):
        out = rules.quality_rules(df)
        mark = "__" if "_kept" in df.columns else "_"
        assert out.columns == [*df.columns, *[mark + c for c in (*rules.STATS, "base_failed", "distance", "kept")]]
        plain = {str(r["doc_id"]): r["kept"] for r in rules.quality_rules(odd_docs, ["doc_id"]).collect()}
        assert {str(r["doc_id"]): r[mark + "kept"] for r in out.collect()} == plain
