import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from alarmloom.llm import counts, queries

PATH = P.path("piece_bpe_32k.model")
MODEL = counts.load(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁ab\n\té漢<s>"), st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=40))
def test_counts_add_up_over_words(text):
    assert sum(counts.lengths(MODEL, counts.words(text))) == len(MODEL.encode(text))


def test_query(spark, sf, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = queries.op7_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        n = len(MODEL.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_table_is_only_a_cache(spark, odd_docs, no_docs, monkeypatch):
    texts = sorted((len((r["text"] or "").encode()), len(MODEL.encode(r["text"] or ""))) for r in odd_docs.collect())
    for size in (counts.TABLE_WORDS, 1):
        monkeypatch.setattr(counts, "TABLE_WORDS", size)
        rows = counts.token_counts(odd_docs, PATH).collect()
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == texts
    assert counts.token_counts(no_docs, PATH).count() == 0
