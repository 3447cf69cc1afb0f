"""Byte-level BPE encoding and decoding with padded matrices.

Each pre-token of a text is encoded separately. Those that a worker has not seen are put into matrices by
length, one byte per cell; in every round each row merges its leftmost pair of least rank, looked up in a hashed
table of pairs, and the matrix is compacted by the one cell that every row has lost. Rows without a pair leave
the matrix. Pre-tokens of more than ``LONGEST`` bytes take the same merges from a heap, whose time does not
grow with the square of their length.

Ids are a binary column of little-endian unsigned 32-bit integers. Null and empty texts have no ids; null ids
of documents stay null; repeated rows get equal rows; no rows give no rows.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
from pyspark.sql import DataFrame

from .common import id_and_text, tune
from .pretokens import WordCache, id_bytes, slices

LONGEST = 128
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for a slot, one gets it
            mine = self.keys[slot[left]] == keys[left]
            self.values[slot[left[mine]]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, NONE for no pair; negative ids are padding."""
        keys = left.astype(np.int64).ravel() << 32 | np.maximum(right, 0).astype(np.int64).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self.slots(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there != -1)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of every pre-token, as bytes."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                out[i] = id_bytes([whole])
            elif len(b) > LONGEST:
                out[i] = id_bytes(self.by_heap(b))
            else:
                buckets.setdefault((len(b) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            for at in range(0, len(rows), 16384):
                part = rows[at:at + 16384]
                for i, ids in zip(part, self.matrix([raw[i] for i in part])):
                    out[i] = ids
        return out

    def matrix(self, words: list[bytes]) -> list[bytes]:
        width, n = max(map(len, words)), len(words)
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.single[flat], np.int32(-1))
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(n), [b""] * n
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE, np.int32)
            live = best != NONE
            for r in np.flatnonzero(~live):
                out[rows[r]] = id_bytes(ids[r, :lengths[r]])
            rows, ids, rank, lengths, at, best = rows[live], ids[live], rank[live], lengths[live] - 1, at[live], best[live]
            if not len(rows):
                break
            k = np.arange(len(rows))
            ids[k, at] = best
            keep = np.ones(ids.shape, bool)
            keep[k, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, bool)
            keep[k, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            if rank.shape[1]:
                left = at > 0
                rank[k[left], at[left] - 1] = self.pairs(ids[k[left], at[left] - 1], ids[k[left], at[left]])
                right = at < rank.shape[1]
                rank[k[right], at[right]] = self.pairs(ids[k[right], at[right]], ids[k[right], at[right] + 1])
        return out

    def by_heap(self, word: bytes) -> list[int]:
        """The same merges for one long pre-token: linked cells and a heap of (rank, place)."""
        ids = [int(i) for i in self.single[np.frombuffer(word, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))

        def rank(i: int):
            return self.ranks.get(word[i:end[after[i]]]) if after[i] < n else None

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] is None or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], end[i] = r, None, end[j]
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return [i for i in ids if i is not None]


class _Encode:
    def __init__(self, ranks_path: str, pattern: str):
        self.ranks_path, self.pattern = ranks_path, pattern

    def __call__(self, batches):
        import pyarrow as pa
        import regex

        find = regex.compile(self.pattern).findall
        cache = WordCache(Encoder(read_ranks(self.ranks_path)).words)
        for b in batches:
            ids = []
            for part in slices(b.column(1).to_pylist()):
                ids += [b"".join(v) for v in cache.values([find(t) for t in part])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])


class _Decode:
    def __init__(self, ranks_path: str):
        self.ranks_path = ranks_path

    def __call__(self, batches):
        import pyarrow as pa

        token = {i: b for b, i in read_ranks(self.ranks_path).items()}.__getitem__
        for b in batches:
            out = [None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
                   for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text."""
    tune(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(_Encode(ranks_path, pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for."""
    tune(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_Decode(ranks_path), "doc_id long, ids binary, decoded binary")
