"""Removal of repeated passages by phrases and windows of words.

A passage repeats if each of its windows of ``WINDOW`` words also starts in a document with a smaller id. Equal phrases and windows
are found by hash, in place of greedy Lempel-Ziv factors, which would need the texts of all reference blocks in every task that
parses. Every document is compared with the documents before it, in two steps:

* Long factors. Texts are cut into phrases at places that depend on the words alone (32 words on average); a phrase
  is taken with the ``WINDOW`` - 1 words that follow it, so that it holds whole windows only. The phrases of all
  documents are the indexed reference, one block for every partition of the hash space. A phrase whose
  reference occurs in a smaller document is one factor: all its windows repeat.
* Factor boundaries. The first occurrence of any window lies in a phrase that is no factor, so only the windows of
  such phrases are left. Each window is named by one anchor in it, the 7-word sequence of least hash. Windows whose anchor
  occurs in one document only cannot repeat; the others are looked up in the index of windows, which
  extends the factors to the word and finds those that are shorter than a phrase.

Sequences are compared by two independent 64-bit hashes. Everything is shuffled by hash or by document, never
by passage; minima are combined before the shuffle, and on the way back the keys with a large share of all rows are joined by
broadcast, so that a passage in a third of all documents stays harmless.

Words are runs without white space. Null texts are empty; a null id is the least id; rows with equal ids do not
repeat each other (repeated rows therefore get equal results); texts of fewer than 13 words lose nothing; no rows give no
rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from .common import col, fresh, identity, share_join, tune
from .pretokens import slices

WINDOW = 13
GRAM = 7
PHRASE = 32
# Bytes of a written table of hashes that is broadcast: as rows and hash table it takes about eight times as much, and the driver holds those of
# earlier joins, too.
SMALL = 1024 * 1024

_rng = np.random.default_rng(2009)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_STEP = [np.uint64(int(x) | 1) for x in _rng.integers(0, 2**64, 4, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), step, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _sums(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, step: np.uint64) -> np.ndarray:
    """Hash of each of the given runs of values; every run holds at least one."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    terms = values[np.repeat(begins, sizes) + place] * _powers(step, int(sizes.max()))[place]
    return _mix(np.add.reduceat(terms, at) + sizes.astype(np.uint64))


class Words:
    """Words of some texts: byte ranges in the joined text, and the first word of every text."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.joined = b"\n".join(raw) + b"\n"
        arr = np.frombuffer(self.joined, np.uint8)
        edge = np.diff((~_SPACE[arr]).view(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text_at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.first = np.searchsorted(self.starts, self.text_at)
        self.bytes = arr

    def hashes(self) -> np.ndarray:
        return _sums(_BYTE[self.bytes], self.starts, self.ends - self.starts, _STEP[0])


def _gram_hash(h: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """Hash of every n consecutive values."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * step + h[j:j + len(out)]
    return _mix(out)


class Parsed:
    """Phrases, anchors and window hashes of the words of one text; needs at least ``WINDOW`` words."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.grams = _gram_hash(h, GRAM, _STEP[1])
        self.windows = len(h) - WINDOW + 1
        low, at = self.grams[:self.windows].copy(), np.arange(self.windows)
        for o in range(1, WINDOW - GRAM + 1):
            g = self.grams[o:o + self.windows]
            less = g < low
            low[less], at[less] = g[less], np.flatnonzero(less) + o
        self.low, self.at = low, at  # anchor of every window: hash and place

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(first window, number of windows) of every phrase."""
        cut = np.flatnonzero(self.grams[1:self.windows] % np.uint64(PHRASE) == 0) + 1
        begins = np.concatenate([[0], cut])
        return begins, np.diff(np.concatenate([begins, [self.windows]]))

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_gram_hash(self.h, WINDOW, s)[which] for s in _STEP[2:4])


def _parse(batches):
    """Rows (rid, rhash, start, n, h1, h2, anchors) of every phrase."""
    import pyarrow as pa

    for b in batches:
        rid, rhash = b.column(0).to_numpy(), b.column(1).to_numpy()
        done = 0
        for part in slices(b.column(2).to_pylist()):
            words = Words(part)
            h = words.hashes()
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            lists = [np.zeros(1, np.int64)]
            total = 0
            for i in range(len(part)):
                own = h[words.first[i]:words.first[i + 1]]
                if len(own) < WINDOW:
                    continue
                p = Parsed(own)
                start, n = p.phrases()
                size = n + WINDOW - 1
                opens = np.concatenate([[True], p.at[1:] != p.at[:-1]])
                opens[start] = True
                chosen = np.flatnonzero(opens)
                upto = np.searchsorted(chosen, start + n) + total
                total += len(chosen)
                lists.append(upto)
                for c, v in zip(cols, (np.full(len(start), rid[done + i]), np.full(len(start), rhash[done + i]), start, n,
                                       _sums(own, start, size, _STEP[2]), _sums(own, start, size, _STEP[3]), p.low[chosen])):
                    c.append(v)
            done += len(part)
            if not total:
                continue
            a, r, s, n, x, y, v = map(np.concatenate, cols)
            anchors = pa.ListArray.from_arrays(pa.array(np.concatenate(lists).astype(np.int32)), pa.array(v.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(r), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(x.view(np.int64)),
                 pa.array(y.view(np.int64)), anchors], ["rid", "rhash", "start", "n", "h1", "h2", "anchors"])


def _factors_mask(windows: int, factors) -> np.ndarray:
    mask = np.zeros(windows, bool)
    for f in factors or ():
        mask[f["start"]:f["start"] + f["n"]] = True
    return mask


def _open_windows(batches):
    """Rows (rid, rhash, at, w1, w2) of the windows outside factors whose anchor other documents share."""
    import pyarrow as pa

    for b in batches:
        rid, rhash, texts, shared, factors = (b.column(i) for i in range(5))
        rid, rhash = rid.to_numpy(), rhash.to_numpy()
        done = 0
        for part in slices(texts.to_pylist()):
            words = Words(part)
            h = words.hashes()
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i in range(len(part)):
                p = Parsed(h[words.first[i]:words.first[i + 1]])
                hashes = shared[done + i].values.to_numpy().view(np.uint64)
                which = np.flatnonzero(np.isin(p.low, hashes) & ~_factors_mask(p.windows, factors[done + i].as_py()))
                x, y = p.window_hashes(which)
                for c, v in zip(cols, (np.full(len(which), rid[done + i]), np.full(len(which), rhash[done + i]), which, x, y)):
                    c.append(v)
            done += len(part)
            a, r, w, x, y = map(np.concatenate, cols)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r), pa.array(w.astype(np.int32)), pa.array(x.view(np.int64)),
                                              pa.array(y.view(np.int64))], ["rid", "rhash", "at", "w1", "w2"])


class _Cut:
    """Texts without the words under repeated windows; a removed run goes with the white space before it."""

    def __init__(self, at: int, names: list[str]):
        self.at, self.names = at, names

    def __call__(self, batches):
        import pyarrow as pa

        k = self.at
        for b in batches:
            found, factors = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            out, counts, spans = [], [], []
            for part in slices([t or "" for t in b.column(k).to_pylist()]):
                words = Words(part)
                for i, text in enumerate(part):
                    row = len(out)
                    lo, hi = words.first[i], words.first[i + 1]
                    n = int(hi - lo)
                    counts.append(n)
                    windows, runs = found[row].as_py(), factors[row].as_py()
                    if not windows and not runs:
                        out.append(text)
                        spans.append([])
                        continue
                    mask = _factors_mask(n - WINDOW + 1, runs)
                    mask[windows or []] = True
                    hit = np.convolve(mask, np.ones(WINDOW, np.int32)) > 0
                    edge = np.diff(hit.view(np.int8), prepend=0, append=0)
                    begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(begins, stops)])
                    keep, at = [], words.text_at[i]
                    for x, y in zip(begins, stops):
                        keep.append(words.joined[at:words.ends[lo + x - 1] if x else words.text_at[i]])
                        at = words.ends[lo + y - 1]
                    keep.append(words.joined[at:words.text_at[i + 1] - 1])
                    out.append(b"".join(keep).decode())
            arrays = [pa.array(out, pa.string()) if i == k else b.column(i) for i in range(b.num_columns - 2)]
            arrays += [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names[:-2], *self.names])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rhash, windows, factors) of the documents that lose words: starts of single repeated windows, and
    factors (start, n) of n repeated windows. ``rid`` and ``rhash`` are those of ``common.identity``."""
    tune(docs.sparkSession)
    rows = docs.select(*identity(docs, id_col, text_col), F.coalesce(col(text_col), F.lit("")).alias("text"))
    phrases = durable(rows.mapInArrow(_parse, "rid long, rhash long, start int, n int, h1 long, h2 long, anchors array<long>"), "rlz")

    times = F.count(F.lit(1)).alias("n")
    known = durable(phrases.groupBy("h1", "h2").agg(F.min("rid").alias("owner"), times).filter("n > 1"), "rlz")
    owned = share_join(phrases.withColumnRenamed("n", "size"), known, ["h1", "h2"], "left", SMALL)
    factors = durable(owned.filter("owner < rid").groupBy("rid", "rhash").agg(
        F.collect_set(F.struct("start", F.col("size").alias("n"))).alias("factors")), "rlz")

    anchors = owned.filter("owner is null or owner >= rid").select("rid", "rhash", F.explode("anchors").alias("anchor"))
    shared = durable(anchors.groupBy("anchor").agg(F.min("rid").alias("x"), F.max("rid").alias("y"), times).filter("x < y").select(
        "anchor", "n"), "rlz")
    open_docs = share_join(anchors, shared, ["anchor"], limit=SMALL).groupBy("rid", "rhash").agg(F.collect_set("anchor").alias("shared"))
    look = durable(open_docs.join(factors, ["rid", "rhash"], "left"), "rlz")
    windows = durable(rows.join(look, ["rid", "rhash"]).select("rid", "rhash", "text", "shared", "factors").mapInArrow(
        _open_windows, "rid long, rhash long, at int, w1 long, w2 long"), "rlz")

    index = durable(windows.groupBy("w1", "w2").agg(F.min("rid").alias("owner"), times).filter("n > 1"), "rlz")
    found = share_join(windows, index, ["w1", "w2"], limit=SMALL).filter("owner < rid").groupBy("rid", "rhash").agg(
        F.collect_set("at").alias("windows"))
    return durable(found.join(factors, ["rid", "rhash"], "full"), "rlz")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the repeated words cut out of the texts, plus the number of words there were and the removed
    word ranges (start, stop); and the names of these two columns: n_words, spans, with underscores before them where taken."""
    from pyspark.sql import types as T

    rid, rhash, windows, factors, n_words, spans = fresh(docs.columns, "rid", "rhash", "windows", "factors", "n_words", "spans")
    lost = repeats(docs, id_col, text_col).toDF(rid, rhash, windows, factors)
    keys = identity(docs, id_col, text_col)
    keyed = docs.select("*", keys[0].alias(rid), keys[1].alias(rhash))
    rows = keyed.join(lost, [rid, rhash], "left").select(*map(col, docs.columns), windows, factors)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(spans, T.ArrayType(
        T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))])
    return rows.mapInArrow(_Cut(docs.columns.index(text_col), [n_words, spans]), schema), n_words, spans
