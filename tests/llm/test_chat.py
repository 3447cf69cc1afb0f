import hashlib
from collections import defaultdict

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from alarmloom.llm import chat, queries

TOKENIZER = P.path("byte_bpe_50k.json")
pieces = st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "[", "<", "\\", "/", "INST]", "s>", "a", " ", "\n", "é"]), max_size=12)


def expected(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        out[c] = (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(pieces.map("".join), pieces.map("".join)), max_size=5))
def test_render_is_reversible(turns):
    text, _ = chat.render(turns, "assistant")
    assert chat.parse(text) == turns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), pieces.map("".join)), max_size=5))
def test_mask_covers_trained_turns_only(turns):
    text, spans = chat.render(turns, "assistant")
    code = chat.encoder(TOKENIZER).encode(text, add_special_tokens=False)
    mask = chat.mask_tokens(code.offsets, spans)
    parts = chat.masked_text(text, [s for s, _ in code.offsets], [e for _, e in code.offsets], mask)
    assert parts == [t for r, t in turns if r == "assistant" and t]


def test_query_reads_back_every_turn(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    says = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", says), (-1, 1, "assistant", says)]
    assert got(queries.op1_chat_formatting(spark, sf)) == expected(rows)


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, ids string, formatted string"
    rows = [(1, 2, "assistant", None), (1, None, None, "x"), (1, 2, "assistant", None), (None, 1, "user", "a"), (None, 0, "assistant", "b"),
            (2, 0, "assistant", "y " * 3000), (2, 1, "user", "z" * 3000), (2, 1, "user", "z" * 3000)]
    df = spark.createDataFrame([(*r, "i", "f") for r in rows], schema)
    for chunk in (chat.CHUNK_CHARS, 100):  # cut conversations give the same
        assert got(chat.digests(chat.format_conversations(df, TOKENIZER, chunk_chars=chunk))) == expected(rows)
    assert chat.digests(chat.format_conversations(df.limit(0), TOKENIZER)).count() == 0
