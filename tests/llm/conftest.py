import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("rid", "rhash", "key", "shard", "slot", "score", "n_words", "spans", "kept", "stats")]])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(60000))
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [
        (1, None, None, None), (2, "", "en", None), (None, "a b c", None, "s"), (None, "a b c", None, "s"), (3, "one", "en", "s"),
        (4, "  two \t words\n", "en", "s"), (5, words, "en", "s"), (6, words, "en", "s"), (6, words, "en", "s"),
        (6, "same id, other text", "en", "s"), (7, "x" * 5000, "de", "t"), (8, passage, "en", "s"), (9, "head " + passage + " tail", "en", "s"),
        (10, passage, None, None), (11, "É漢字   🙂 don't\r\n\v\f <|endoftext|> </s>", "fr", "t"), (12, " ▁ lead and trail  ", "fr", "t"),
        (13, "\n\n\n", "fr", "t"), (14, "Idiot stupid loser " * 5, "en", "s"), (15, "A b a b a b", "en", "s"),
    ]
    return spark.createDataFrame([(*r, None, *["c"] * 10) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
