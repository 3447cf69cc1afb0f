import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from alarmloom.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS)


def ids(text):
    import regex

    return [i for b in ENCODER.words(regex.findall(P.PATTERN, text)) for i in np.frombuffer(b, "<u4").tolist()]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_encode_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 3000, "ab" * 700, "ing" * 100, " " * 500 + "a", "é漢" * 300, "\r\n\v\f\x1c\x85   ", "'s'S'll 're"])
def test_long_and_odd_pretokens(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    for word in (text[:90], text[:128]):
        raw = word.encode()
        if len(raw) > 1 and raw not in RANKS and len(raw) <= bpe.LONGEST:
            assert np.frombuffer(ENCODER.matrix([raw])[0], "<u4").tolist() == ENCODER.by_heap(raw)


def test_query(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = queries.op5_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        raw = np.array(want, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = bpe.decode(bpe.encode(odd_docs, PATH, P.PATTERN), PATH).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted(t.encode() for t in texts)
    assert bpe.decode(bpe.encode(no_docs, PATH, P.PATTERN), PATH).count() == 0
