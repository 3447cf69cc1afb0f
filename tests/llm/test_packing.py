import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alarmloom.llm import packing, queries

LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "'s", "é", "漢", "\n", "\x1c", "1", "<|", "|>", "Ⅷ"]), max_size=30).map("".join))
def test_ids_are_the_library_s(text):
    ids = packing.Ids(*queries.PACKING, 0) if not hasattr(packing, "_test_ids") else packing._test_ids
    packing._test_ids = ids
    assert np.frombuffer(ids(text), "<u4").tolist() == library(text)


def test_first_fit_decreasing_against_scan():
    rnd = random.Random(4)
    for _ in range(50):
        sizes = [rnd.randint(1, 100) for _ in range(rnd.randint(0, 120))]
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
            want[i] = (at, 100 - room[at])
            room[at] -= sizes[i]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets))} == want


def check(pieces, texts):
    """Every id in one piece, sequences gapless and at most 1 024 long; texts by id, ids are unique."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for i, ps in by_doc.items():
        want, at = library(texts[i]), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want)
            raw = np.array(want[at:at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(raw)
            at += p["length"]
        assert at == len(want)
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(p["length"] for p in pieces) / (1024 * len(by_sequence))


def test_query(spark, sf, documents):
    fill = check(queries.op4_packing(spark, sf).collect(), {r["doc_id"]: r["text"] or "" for r in documents.collect()})
    assert fill > 0.97


def test_odd_rows(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, *queries.PACKING).collect()
    want = sorted(len(library(r["text"] or "")) for r in odd_docs.collect())
    assert sum(p["length"] for p in pieces) == sum(want)
    assert sorted(p["doc_tokens"] for p in pieces if p["start"] == 0) == want
    assert packing.pack(no_docs, *queries.PACKING).count() == 0


def test_many_groups(documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    pieces = packing.pack(documents, *queries.PACKING, group_bytes=20_000).withColumn(
        "ids_crc32", __import__("pyspark.sql.functions", fromlist=["crc32"]).crc32("ids")).collect()
    assert len({p["sequence_id"] >> 32 for p in pieces}) > 5
    check(pieces, texts)
