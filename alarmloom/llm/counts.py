"""Token counts by a two-tier lookup of pre-token lengths on the map side.

The vocabulary's pieces hold the space mark at their start only, so that a text's count is the sum over its
words with the spaces before them. First tier: a broadcast table of the lengths of frequent words, at most
``TABLE_WORDS`` words of at most ``TABLE_CHARS`` characters. Second tier: a worker's bounded cache, whose misses the library
encodes. Words are never shuffled: every task counts the words of its whole texts in a bounded summary, and
only the summaries' heads are added up for the table, which changes no count, only where it is found.

Null and empty texts have no tokens; null ids stay null; repeated rows get equal rows; no rows give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, tune
from .pretokens import WordCache, slices

TABLE_WORDS = 1 << 16
TABLE_CHARS = 32
TASK_WORDS = 8192
SUMMARY_WORDS = 100_000
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def words(text: str) -> list[str]:
    """Words of a text without the one space mark in front that each of them has."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]


def lengths(model, found: list[str]) -> list[int]:
    return [len(ids) if w else 1 for w, ids in zip(found, model.encode(found, num_threads=1))]


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _heads(batches):
    """(word, n): the frequent words of a task; rare ones are dropped from the summary when it is full."""
    import pyarrow as pa

    seen: dict[str, int] = {}
    from collections import Counter

    floor = 0
    for b in batches:
        for part in slices(b.column(0).to_pylist()):
            for w, n in Counter(w for t in part for w in words(t)).items():
                seen[w] = seen.get(w, 0) + n
            while len(seen) > SUMMARY_WORDS:
                floor += 1
                seen = {w: n for w, n in seen.items() if n > floor}
    top = sorted(((n, w) for w, n in seen.items() if len(w) <= TABLE_CHARS), reverse=True)[:TASK_WORDS]
    yield pa.RecordBatch.from_arrays([pa.array([w for _, w in top], pa.string()), pa.array([n for n, _ in top], pa.int64())],
                                     ["word", "n"])


def frequent_lengths(texts: DataFrame, model_path: str) -> dict[str, int]:
    """Lengths of the most frequent words of a column ``text``; at most TABLE_WORDS of them."""
    heads = texts.select("text").mapInArrow(_heads, "word string, n long")
    top = heads.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE_WORDS)
    found = [r["word"] for r in top.collect()]
    return dict(zip(found, lengths(load(model_path), found)))


class _Count:
    def __init__(self, table, model_path: str):
        self.table, self.model_path = table, model_path

    def __call__(self, batches):
        import pyarrow as pa

        model, frequent = load(self.model_path), self.table.value
        rare = WordCache(lambda missing: lengths(model, missing))
        for b in batches:
            out = []
            for part in slices(b.column(1).to_pylist()):
                split = [words(t) for t in part]
                near = [list(map(frequent.get, ws)) for ws in split]
                far = rare.values([[w for w, n in zip(ws, ns) if n is None] for ws, ns in zip(split, near)])
                out += [sum(filter(None, ns)) + sum(more) for ns, more in zip(near, far)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""
    spark = docs.sparkSession
    tune(spark)
    rows = id_and_text(docs, id_col, text_col)
    table = spark.sparkContext.broadcast(frequent_lengths(rows, model_path))
    return rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        _Count(table, model_path), "doc_id long, n_bytes long, n_tokens long")
