"""Packing by first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids, with id 0 at their end, are cut into whole sequences and a rest; the rests of a group are taken
from the longest to the shortest, and each goes to the first bin that has room, which a tournament tree over
the bins' capacities finds in logarithmic time. A group holds about ``GROUP_BYTES`` of text, whatever the
size of the corpus; rows are dealt to groups by a hash of their place and id, so that equal rows spread too.

Null and empty texts are one piece of id 0; null ids stay null; repeated rows are packed each; no rows give
no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import id_and_text, tune
from .pretokens import id_bytes

LENGTH = 1024
GROUP_BYTES = 2 * 1024 * 1024
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every item; every size is between 1 and the capacity."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)  # a node holds the most room below it
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        size, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


class Ids:
    """Ids of whole texts with the end id. The rank file holds the vocabulary of the tokenizers library's file, and
    ``special`` its special token, which a text may name."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int], end: int):
        import tiktoken

        self.code = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=special)
        self.special, self.end = set(special), id_bytes([end])

    def __call__(self, text: str) -> bytes:
        ids = self.code.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        return ids.astype("<u4").tobytes() + self.end


class _Pack:
    def __init__(self, length: int, *encoder):
        self.length, self.encoder, self.ids = length, encoder, None

    def __getstate__(self):
        return self.length, *self.encoder

    def __setstate__(self, state):
        self.__init__(*state)

    def __call__(self, key, table):
        import pyarrow as pa

        if self.ids is None:
            self.ids = Ids(*self.encoder)
        group, length = key[0].as_py(), self.length
        # the same rows give the same pieces, in whatever order they arrive
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        pieces = []
        for doc, text in rows:
            ids = self.ids(text)
            n = len(ids) // 4
            pieces += [(doc, s, min(length, n - s), ids[4 * s:4 * min(s + length, n)], n) for s in range(0, n, length)]
        bins, offsets = first_fit_decreasing([p[2] for p in pieces], length)
        base = group << 32
        cols = [*zip(*pieces)] or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(cols, types)]
        arrays += [pa.array(np.array(bins, np.int64) + base), pa.array(np.array(offsets, np.int64))]
        return pa.Table.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], length: int = LENGTH, end: int = 0,
    id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``PIECES``: every id of every document in exactly one piece, pieces gapless in their sequence.

    ``ids`` are little-endian unsigned 32-bit integers; ``sequence_id`` is the group's number and a number
    within the group."""
    tune(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 8)).head()[0] or 0
    groups = max(1, -(-total // group_bytes))
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id"), F.lit(groups)).alias("grp")
    one = _Pack(length, ranks_path, pattern, special, end)
    return rows.select(group, "doc_id", "text").groupBy("grp").applyInArrow(lambda key, table: one(key, table), PIECES)
