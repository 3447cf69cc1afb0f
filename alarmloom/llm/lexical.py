"""Ranked lexical search with a K2-treap over the term-document grid.

Every item gets the ``top`` documents of highest score. Terms are runs of ASCII letters and digits and of all characters beyond
ASCII, only A to Z lower-cased. With N documents that have a term, L terms in all of them, n terms in a document and tf of them
equal to a term that df documents hold: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + 90 n N div L, and the score
sums w * (10**9 tf div (1000 tf + 8 m)), the impact, over the distinct terms of the item, in 64-bit integers.

Grid. Documents are columns, the terms of all items are rows (no other row is ever asked for). The documents of a task are cut
into blocks of at most ``BLOCK`` documents or ``POINTS`` points. A block's grid is a square whose quarters, their
quarters and so on down to single points are the cells of a tree; empty cells are left out. A cell is a mask of its four
children and what its greatest impact is less than its parent's, which is small near the points. Rows are in order of frequency, so that
rare terms share cells that are nearly empty.

Search. A state is an item, a range of columns and the cells on the paths of the item's rows there; the weighted greatest
impacts of those cells bound the score of every document of the range. All rows of an item descend together to either half
of the range; best bounds go first, ``WIDTH`` ranges of an item at a time (an eighth of those that wait, where that is more), for many
items at once. A range is dropped when its bound is below the
item's tenth score, or equal to it with no smaller document id; at single columns the bound is the score. The ten best
of a task are carried from block to block, so that later blocks are cut off earlier. The result is exact.

Texts are read once: the first job writes the counts of item terms of every document (no text), from which N, L and df are summed.
Documents are never shuffled; a task hands on at most ``top`` rows an item, which are merged by ranges of documents and then by
item. Items are looked up in blocks of about ``ITEM_TERMS`` terms, so that what tasks are told is bounded; each such block is a job.

Null texts hold no term, nor do empty ones; a document without terms is never found. A null document id is the least id. Rows of
one document id are documents of their own; rows of one item id are one item with the terms of all its texts (so repeated rows change
nothing), a null item id is an item like any other. Items without a term found give no row; no rows give no rows. Terms
are compared by 128 bits of hash. Columns that are not named are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable, union_all
from .common import NULL_ID, col, tune
from .pretokens import slices
from .substrings import _BYTE, _STEP, _sums

TOP = 10
BLOCK = 4096
POINTS = 4_000_000
WIDTH = 8
# Pairs of item and row that descend together.
TOGETHER = 4096
# Pairs of item and term of a block of items, 32 bytes each in every task; an item is never cut.
ITEM_TERMS = 1 << 18
# How many ways the rows of an item are merged before they meet in one task.
WAYS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def term_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, two hashes) of every term; terms of a text are together and in order."""
    raw = [t.encode() for t in texts]
    arr = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.diff(_IN_TERM[arr].view(np.int8), prepend=0, append=0)
    starts, sizes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = sizes - starts
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    values = _BYTE[_LOWER[arr]]
    return np.searchsorted(ends, starts, "right"), _sums(values, starts, sizes, _STEP[0]), _sums(values, starts, sizes, _STEP[1])


class _Counts:
    """Rows (doc_id, text) to (doc_id, n_terms, rows, tfs): how often a document holds each of the known terms."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.h1, self.h2 = h1, h2  # ordered by h1

    def __call__(self, batches):
        import pyarrow as pa

        for b in batches:
            n, at, rows, tfs = [], [np.zeros(1, np.int64)], [], []
            base = 0
            for part in slices(b.column(1).to_pylist()):
                text, x, y = term_hashes(part)
                n.append(np.bincount(text, minlength=len(part)))
                place = np.minimum(np.searchsorted(self.h1, x), max(len(self.h1) - 1, 0))
                hit = np.flatnonzero((self.h1[place] == x) & (self.h2[place] == y)) if len(self.h1) else np.zeros(0, np.int64)
                pair, tf = np.unique(text[hit] * np.int64(max(len(self.h1), 1)) + place[hit], return_counts=True)
                of = pair // max(len(self.h1), 1)
                rows.append((pair % max(len(self.h1), 1)).astype(np.int32))
                tfs.append(tf.astype(np.int32))
                at.append(base + np.cumsum(np.bincount(of, minlength=len(part))))
                base += len(pair)
            if not n:
                continue
            at = pa.array(np.concatenate(at).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(v))) for v in (rows, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n).astype(np.int64)), *lists],
                                             ["doc_id", "n_terms", "rows", "tfs"])


class Treap:
    """Cells of the quadtree over points (row, column, impact), level by level, children of one cell together.

    ``first`` is the place of a cell's first child, ``mask`` its non-empty quarters (2 * lower half of the rows + right
    half of the columns), ``less`` what its greatest impact is less than its parent's."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, depth: int):
        self.depth = depth
        code = np.zeros(len(rows), np.int64)
        for bit in range(depth):
            code |= ((rows.astype(np.int64) >> bit & 1) << (2 * bit + 1)) | ((cols.astype(np.int64) >> bit & 1) << (2 * bit))
        order = np.argsort(code, kind="stable")
        code, most = code[order], impacts[order].astype(np.int32)
        levels = [(code, most, np.zeros(len(code), np.uint8))]
        for _ in range(depth):
            up = code >> 2
            head = np.flatnonzero(np.diff(up, prepend=-1))
            mask = np.bitwise_or.reduceat(np.left_shift(1, code & 3), head).astype(np.uint8)
            code, most = up[head], np.maximum.reduceat(most, head)
            levels.append((code, most, mask))
        levels.reverse()
        less = [levels[0][1] * 0]
        for (_, above, mask), (_, most, _) in zip(levels, levels[1:]):
            less.append(np.repeat(above, _ONES[mask]) - most)
        self.top = int(levels[0][1][0])
        self.mask = np.concatenate([x[2] for x in levels])
        self.less = np.concatenate(less)
        self.first = 1 + np.concatenate([[0], np.cumsum(_ONES[self.mask][:-1])])

    def child(self, cells: np.ndarray, most: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether there is one, cell, greatest impact) of the children in the given quarters."""
        mask = self.mask[cells]
        there = (mask >> quarter & 1).astype(bool)
        at = self.first[cells] + _ONES[mask & ((1 << quarter) - 1)]
        at = np.where(there, at, 0)
        return there, at.astype(np.int32), most - self.less[at]


_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


class Best:
    """The ``top`` best (score, document) of every item so far; ``least`` and ``last`` are those of the worst of a full list."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item = np.zeros(0, np.int64)
        self.score, self.doc = self.item, self.item
        self.least, self.last = np.zeros(items, np.int64), np.zeros(items, np.int64)
        self.full = np.zeros(items, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        worst = np.flatnonzero(place == self.top - 1)
        self.full[item[worst]] = True
        self.least[item[worst]], self.last[item[worst]] = score[worst], doc[worst]

    def open(self, item: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which ranges with these bounds and least documents may still change the list of their item."""
        least = self.least[item]
        return (bound > 0) & (~self.full[item] | (bound > least) | ((bound == least) & (doc < self.last[item])))


def descend(treap: Treap, docs: np.ndarray, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best, width: int = WIDTH) -> int:
    """Best-first descent of all items (pairs of item and row, items together) over the columns of one block, whose
    ``docs`` ascend. Returns how many ranges were looked at."""
    heads = np.flatnonzero(np.diff(item, prepend=-1))
    # ranges: item, bound, first column, level; pairs of range k are pairs[at[k]:at[k] + n[k]]
    of, size = item[heads], np.diff(np.append(heads, len(item)))
    level, left = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    bound = np.add.reduceat(weight, heads) * treap.top
    at, cell, most, pair = heads, np.zeros(len(item), np.int32), np.full(len(item), treap.top, np.int32), np.arange(len(item), dtype=np.int32)
    looked = 0
    while True:
        alive = best.open(of, bound, docs[left])
        of, size, level, left, bound, at = (v[alive] for v in (of, size, level, left, bound, at))
        if not len(of):
            return looked
        order = np.lexsort((left, -bound, of))
        head = np.searchsorted(of[order], of[order])
        place = np.arange(len(of)) - head
        first = place < np.maximum(width, (np.searchsorted(of[order], of[order], "right") - head) // width)
        go, stay = order[first], order[~first]
        looked += len(go)
        # the pairs of the chosen ranges, each once for either half of the columns
        n = size[go]
        flat = np.repeat(at[go] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        depth = treap.depth - 1 - np.repeat(level[go], n)
        made = []
        for half in (0, 1):
            lower = row[pair[flat]] >> depth & 1
            there, child, top = treap.child(cell[flat], most[flat], 2 * lower + half)
            r = np.repeat(np.arange(len(go)), n)[there]
            p = pair[flat][there]
            made.append((r, p, child[there], top[there], half))
        new = []
        base = 0
        for r, p, child, top, half in made:
            if not len(r):
                continue
            head = np.flatnonzero(np.diff(r, prepend=-1))
            ranges = r[head]
            start = left[go][ranges] + (half << (treap.depth - 1 - level[go][ranges]))
            new.append((of[go][ranges], np.diff(np.append(head, len(r))), level[go][ranges] + 1, start,
                        np.add.reduceat(weight[p] * top, head), base + head, p, child, top))
            base += len(r)
        # what stays keeps its pairs, behind the new ones
        n = size[stay]
        flat = np.repeat(at[stay] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        new.append((of[stay], n, level[stay], left[stay], bound[stay], base + np.cumsum(n) - n, pair[flat], cell[flat], most[flat]))
        of, size, level, left, bound, at, pair, cell, most = (np.concatenate(v) for v in zip(*new))
        done = level == treap.depth
        if done.any():
            best.add(of[done], bound[done], docs[left[done]])
            of, size, level, left, bound, at = (v[~done] for v in (of, size, level, left, bound, at))


class _Search:
    """Rows (doc_id, n_terms, rows, tfs) to the best (item, doc_id, score) of the task."""

    def __init__(self, names, item, row, weight, place, n_docs: int, n_terms: int, top: int, block: int, points: int):
        self.names, self.item, self.row, self.weight = names, item, row, weight  # ordered by item; rows by frequency
        self.place = place  # of a known term among the rows
        self.n_docs, self.n_terms, self.top, self.block, self.points = n_docs, n_terms, top, block, points

    def blocks(self, batches):
        """Lists of batches that make up a block; documents without an asked term are left out."""
        import pyarrow as pa

        held, docs, points = [], 0, 0
        for b in batches:
            b = b.filter(pa.array(_list_sizes(b.column(2)) > 0))
            at = 0
            while at < b.num_rows:
                sizes = np.cumsum(_list_sizes(b.column(2).slice(at)))
                take = min(self.block - docs, max(1, int(np.searchsorted(sizes, self.points - points, "right"))), b.num_rows - at)
                held.append(b.slice(at, take))
                docs, points, at = docs + take, points + int(sizes[take - 1]), at + take
                if docs >= self.block or points >= self.points:
                    yield held
                    held, docs, points = [], 0, 0
        if held:
            yield held

    def __call__(self, batches):
        import pyarrow as pa

        best = Best(len(self.names), self.top)
        for held in self.blocks(batches):
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            sizes = np.concatenate([_list_sizes(b.column(2)) for b in held])
            rows, tfs = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in (2, 3))
            rows = self.place[rows]
            by = np.argsort(ids, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            # Python's integers where 90 n N may leave 64 bits
            m = 10 + (90 * n * self.n_docs // self.n_terms if 90 * int(n.max()) * self.n_docs < 2**62 else np.array(
                [90 * int(x) * self.n_docs // self.n_terms for x in n], np.int64))
            tf = tfs.astype(np.int64)
            impact = 10**9 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            some = impact > 0
            cols = np.repeat(place, sizes)[some]
            if not len(cols):
                continue
            used = np.unique(rows[some])  # rows in order of frequency, without those that no document holds
            depth = max(int(len(used) - 1).bit_length(), int(len(by) - 1).bit_length(), 1)
            treap = Treap(np.searchsorted(used, rows[some]), cols, impact[some], depth)
            at = np.minimum(np.searchsorted(used, self.row), len(used) - 1)
            asked = used[at] == self.row
            docs = np.concatenate([ids[by], np.full((1 << depth) - len(by), 2**63 - 1)])
            item, row, weight = self.item[asked], at[asked], self.weight[asked]
            cuts = np.searchsorted(item, item[::TOGETHER])  # items stay whole
            for lo, hi in zip(cuts, [*cuts[1:], len(item)]):
                if hi > lo:
                    descend(treap, docs, item[lo:hi], row[lo:hi], weight[lo:hi], best)
        yield pa.RecordBatch.from_arrays([pa.array(self.names[best.item]), pa.array(best.doc), pa.array(best.score)],
                                         ["item", "doc_id", "score"])


def _list_sizes(lists) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_numpy()


def _item_terms(batches):
    """Rows (item, text) to (item, h1, h2)."""
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            text, x, y = term_hashes(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))],
                                             ["item", "h1", "h2"])


def _weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    import math

    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block: int = BLOCK, points: int = POINTS, item_terms: int = ITEM_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item."""
    tune(docs.sparkSession)
    spark = docs.sparkSession
    text = lambda c: F.coalesce(col(c), F.lit("")).alias("text")
    known = F.coalesce(col(item_col).cast("long"), F.lit(NULL_ID)).alias("item")
    asked = durable(items.select(known, text(item_text_col)).mapInArrow(_item_terms, "item long, h1 long, h2 long").distinct(), "lexical")
    rows = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text(text_col))
    parts = -(-asked.count() // item_terms) or 1
    found = union_all([_found(rows, asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == i), top, block, points) for i in range(parts)])
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    first = Window.partitionBy("item", "way").orderBy(F.desc("score"), "doc_id")
    some = found.withColumn("way", F.pmod(F.xxhash64("doc_id"), F.lit(WAYS))).withColumn("rank", F.row_number().over(first)).filter(
        F.col("rank") <= top)
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return some.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select(
        null("item").alias("item_id"), "rank", null("doc_id").alias("doc_id"), "score")


def _found(rows: DataFrame, asked: DataFrame, top: int, block: int, points: int) -> DataFrame:
    """(item, doc_id, score): the best of every task for a bounded block of items."""
    spark = rows.sparkSession
    table = asked.toArrow()
    item, h1, h2 = (table.column(c).to_numpy() for c in ("item", "h1", "h2"))
    terms, of = np.unique(np.stack([h1.view(np.uint64), h2.view(np.uint64)]), axis=1, return_inverse=True)
    counts = durable(rows.mapInArrow(_Counts(terms[0], terms[1]), "doc_id long, n_terms long, rows array<int>, tfs array<int>"), "lexical")
    total = counts.agg(F.count_if(F.col("n_terms") > 0).alias("docs"), F.sum("n_terms").alias("terms")).head()
    held = counts.select(F.explode("rows").alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(terms.shape[1], np.int64)
    df[held.column("row").to_numpy()] = held.column("df").to_numpy()
    # only terms that some document holds are rows of the grid; rows in order of frequency
    names, item = np.unique(item, return_inverse=True)
    order = np.lexsort((np.arange(len(df)), df))
    place = np.empty(len(df), np.int64)
    place[order] = np.arange(len(df))
    pairs = np.flatnonzero(df[of] > 0)
    pairs = pairs[np.lexsort((place[of[pairs]], item[pairs]))]
    if not len(pairs):
        return spark.createDataFrame([], "item long, doc_id long, score long")
    weight = _weights(total["docs"], df)
    task = _Search(names, item[pairs], place[of[pairs]], weight[of[pairs]], place, total["docs"], total["terms"], top, block, points)
    return durable(counts.select("doc_id", "n_terms", "rows", "tfs").mapInArrow(task, "item long, doc_id long, score long"), "lexical")
