import hashlib
import random
import re

from alarmloom.llm import queries, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def kept(rows):
    """Kept words of (id, text) rows, windows compared in full; a null id is the least."""
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            if key not in first or order(i) < first[key]:
                first[key] = order(i)
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = {k + d for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < order(i) for d in range(13)}
        out.append((i, len(w), len(gone), tuple(x for k, x in enumerate(w) if k not in gone)))
    return out


def got(df, name="n_words", spans="spans"):
    return sorted(((r["doc_id"], r[name], sum(s["stop"] - s["start"] for s in r[spans]), tuple(WORD.findall(r["text"] or "")))
                   for r in df.collect()), key=str)


def test_query(spark, sf, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = sorted((i, n, k, hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, n, k, w in kept(rows))
    assert sorted(tuple(r) for r in queries.op9_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert any(k for _, _, k, _ in want)


def test_planted_passages(spark):
    """Passages of 10 to 200 words at all alignments, few words, many repeats."""
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    passages = [rnd.choices(vocab, k=rnd.choice([10, 12, 13, 14, 20, 55, 90, 200])) for _ in range(25)]
    rows = []
    for i in range(240):
        words = rnd.choices(vocab, k=rnd.randint(0, 60))
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            at, lo = rnd.randint(0, len(words)), rnd.randint(0, 3)
            words[at:at] = p[lo:]
        if i % 17 == 0:
            words = ["same"] * rnd.randint(5, 40)
        rows.append((i // 2 if i % 40 == 0 else i, "  ".join(words) if i % 2 else "\n".join(words)))
    cut, n, s = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(cut, n, s) == sorted(kept(rows), key=str)


def test_what_is_kept_keeps_its_layout(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, passage), (2, f"one\n\ttwo {passage}\nthree  four "), (3, "a  b\n")], "doc_id long, text string")
    cut, _, _ = substrings.remove_repeats(df)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: passage, 2: "one\n\ttwo\nthree  four ", 3: "a  b\n"}


def test_odd_rows(odd_docs, no_docs):
    cut, n, s = substrings.remove_repeats(odd_docs)
    assert (n, s) == ("_n_words", "_spans") and cut.columns == [*odd_docs.columns, n, s]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(cut, n, s) == sorted(kept(rows), key=str)
    empty, _, _ = substrings.remove_repeats(no_docs)
    assert empty.count() == 0


def test_large_tables_of_hashes_are_not_broadcast(spark, documents, monkeypatch):
    """Whether tables of hashes are small enough to be broadcast changes no result."""
    cut = lambda: sorted((r["doc_id"], r["text"], r["n_words"]) for r in substrings.remove_repeats(documents)[0].collect())
    want = cut()
    sizes = []
    monkeypatch.setattr(substrings, "SMALL", -1)
    joined = substrings.share_join

    def seen(*args, **kwargs):
        sizes.append(kwargs.get("limit", args[4] if len(args) > 4 else None))
        return joined(*args, **kwargs)

    monkeypatch.setattr(substrings, "share_join", seen)
    assert cut() == want and sizes == [-1, -1, -1]
