import math
import re
from collections import Counter

import numpy as np
import pytest

from alarmloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    df = Counter(t for _, c, _ in counts for t in c)
    n_docs, total = len(counts), sum(n for *_, n in counts)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c, n in counts:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in words if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(scored[:top])]
    return sorted(out, key=str)


def found(docs, items, **how):
    return sorted((tuple(r) for r in lexical.search(docs, items, **how).collect()), key=str)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


SMALL = [{}, {"block": 7, "points": 40, "item_terms": 100}, {"top": 3, "block": 64}]


@pytest.mark.parametrize("how", SMALL)
def test_brute_force(spark, sf, documents, how):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = expected(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"), how.get("top", 10))
    assert found(documents, items, **how | {"item_terms": 5 * how.get("item_terms", 10**6)}) == want


@pytest.mark.parametrize("how", SMALL)
def test_odd_rows(spark, odd_docs, no_docs, how):
    items = spark.createDataFrame(
        [(1, "W1x1 P3, idiot! É漢字"), (1, "w1x1"), (2, None), (None, "a B c"), (3, ""), (4, "nowhere to be found"), (5, "text other w2x2 " * 3)],
        "item_id long, text string")
    want = expected(pairs(odd_docs, "doc_id", "text"), pairs(items, "item_id", "text"), how.get("top", 10))
    assert len(want) > 8
    assert found(odd_docs, items, **how) == want
    assert found(no_docs, items, **how) == found(odd_docs, items.limit(0), **how) == []


@pytest.mark.parametrize("how", SMALL)
def test_ties_go_to_the_smaller_document(spark, how):
    """A third of all documents are copies that every item finds."""
    docs = spark.range(900).selectExpr(
        "(id * 7919) % 900 AS doc_id", "if(id % 3 = 0, 'the same words again', concat('other words ', id % 50, ' here')) AS text")
    items = spark.createDataFrame([(i, f"same words {i % 50} here") for i in range(60)], "item_id long, text string")
    want = expected(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), how.get("top", 10))
    assert found(docs, items, **how) == want


def test_treap_holds_maxima_and_little_else():
    rng = np.random.default_rng(3)
    rows, cols = rng.integers(0, 50, 400), rng.integers(0, 120, 400)
    cells = {}
    for r, c in zip(rows, cols):
        cells[r, c] = int(rng.integers(1, 1000))
    r, c = np.array(list(cells)).T
    treap = lexical.Treap(r, c, np.array(list(cells.values())), 7)
    assert treap.top == max(cells.values()) and len(treap.mask) <= 8 * len(cells)
    for (x, y), value in cells.items():
        cell, most = np.array([0]), np.array([treap.top])
        for level in range(7):
            shift = 6 - level
            there, cell, most = treap.child(cell, most, np.array([2 * (x >> shift & 1) + (y >> shift & 1)]))
            inside = [v for (a, b), v in cells.items() if a >> shift == x >> shift and b >> shift == y >> shift]
            assert there[0] and most[0] == max(inside)
    there, _, _ = treap.child(np.array([0]), np.array([treap.top]), np.array([3]))
    assert not there[0]  # rows end at 50 of 128


def test_descent_leaves_ranges_out():
    """Most columns hold common rows only; the bound keeps them from being looked at."""
    rng = np.random.default_rng(4)
    n = 4096
    common = np.repeat(np.arange(8, 16), n)
    rare = np.repeat(np.arange(8), 3)
    rows = np.concatenate([rare, common])
    cols = np.concatenate([rng.choice(64, len(rare)), np.tile(np.arange(n), 8)])
    rows, cols = np.unique(np.stack([rows, cols]), axis=1)
    treap = lexical.Treap(rows, cols, np.full(len(rows), 1000), 12)
    weight = np.where(np.arange(16) < 8, 9000, 10)
    best = lexical.Best(1, 10)
    looked = lexical.descend(treap, np.arange(n), np.zeros(16, np.int64), np.arange(16), weight, best)
    score = np.bincount(cols, weight[rows] * 1000, n).astype(np.int64)
    want = np.lexsort((np.arange(n), -score))[:10]
    assert best.doc.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert looked < 1200
