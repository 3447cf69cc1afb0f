"""Chat formatting with loss masks aligned by character offsets.

A conversation is rendered as a whole, ``[INST]role[/INST]text</s>`` turn after turn, and encoded once with
offsets; the sorted spans of the trained turns are then intersected with the token spans by binary search.
The three control strings are single tokens of the encoder, so that no token straddles a turn. Inside roles
and texts a backslash is put into everything that looks like a control string, and taken out on the way back.

Rows of one conversation are sorted inside their partition and streamed, so that memory is bounded even for a
conversation with a third of all rows: what exceeds ``CHUNK_CHARS`` is cut between turns into several output
rows, which changes neither the tokens nor the text. Null texts and roles are empty; rows with a null
conversation id form one conversation; ties of ``turn`` are ordered by role and text, null turns come first;
repeated rows are turns of their own; no rows give no rows.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, tune

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CHUNK_CHARS = 1 << 18
FORMATTED = ("conv_id long, chunk int, n_turns long, formatted string, ids array<int>, starts array<int>, "
             "ends array<int>, mask array<boolean>")

_CONTROL = re.compile(r"\[(\\*)(/?INST\])|<(\\*)(/s>)")
_ESCAPED = re.compile(r"\[\\(\\*)(/?INST\])|<\\(\\*)(/s>)")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"[\\{m[1]}{m[2]}" if m[2] else f"<\\{m[3]}{m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"[{m[1]}{m[2]}" if m[2] else f"<{m[3]}{m[4]}", text)


def render(turns: list[tuple[str, str]], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the sorted character spans of the trained turns' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask_tokens(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each token overlaps a trained span: the only candidate is the first span that ends after it starts."""
    ends = [e for _, e in spans]
    out = []
    for s, e in offsets:
        i = bisect.bisect_right(ends, s)
        out.append(i < len(spans) and spans[i][0] < e)
    return out


def masked_text(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> list[str]:
    """Unescaped text under each run of masked tokens."""
    out, begin, stop = [], None, 0
    for s, e, m in zip(starts, ends, mask):
        if m:
            begin, stop = (s if begin is None else begin), e
        elif begin is not None:
            out.append(unescape(formatted[begin:stop]))
            begin = None
    if begin is not None:
        out.append(unescape(formatted[begin:stop]))
    return out


def encoder(path: str):
    """The public tokenizer with the control strings as tokens of their own and untrimmed offsets."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (OPEN, CLOSE, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def format_conversations(
    turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", trained: str = "assistant", chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """``FORMATTED`` rows: rendered text, token ids, their character spans and the loss mask of each conversation."""
    tune(turns.sparkSession)
    empty = F.lit("")
    rows = turns.select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).cast("long").alias("turn"),
        F.coalesce(col(role_col), empty).alias("role"), F.coalesce(col(text_col), empty).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_Formatter(tokenizer, trained, chunk_chars), FORMATTED)


class _Formatter:
    def __init__(self, tokenizer: str, trained: str, chunk_chars: int):
        self.tokenizer, self.trained, self.chunk_chars = tokenizer, trained, chunk_chars

    def chunks(self, batches):
        """(conv_id, chunk, turns) in order; a conversation goes on over batches."""
        conv, turns, size, chunk, begun = None, [], 0, 0, False
        for b in batches:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if begun and (c != conv or size >= self.chunk_chars):
                    yield conv, chunk, turns
                    chunk, turns, size = (chunk + 1 if c == conv else 0), [], 0
                conv, begun = c, True
                turns.append((role, text))
                size += len(text) + len(role)
        if begun:
            yield conv, chunk, turns

    def __call__(self, batches):
        import pyarrow as pa

        encode, rows, size = encoder(self.tokenizer), [], 0

        def out():
            made = [(c, k, len(t), *render(t, self.trained)) for c, k, t in rows]
            codes = encode.encode_batch([m[3] for m in made], add_special_tokens=False)
            offsets = [e.offsets for e in codes]
            return pa.RecordBatch.from_arrays([
                pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int32()),
                pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], pa.string()),
                pa.array([e.ids for e in codes], pa.list_(pa.int32())),
                pa.array([[s for s, _ in o] for o in offsets], pa.list_(pa.int32())),
                pa.array([[e for _, e in o] for o in offsets], pa.list_(pa.int32())),
                pa.array([mask_tokens(o, m[4]) for o, m in zip(offsets, made)], pa.list_(pa.bool_())),
            ], ["conv_id", "chunk", "n_turns", "formatted", "ids", "starts", "ends", "mask"])

        for row in self.chunks(batches):
            rows.append(row)
            size += sum(len(t) for _, t in row[2])
            if size >= self.chunk_chars:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, n_tokens long, loss_tokens long")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted text and the loss mask.

    Works on the output of ``format_conversations`` as it is partitioned: the chunks of a conversation follow
    each other."""
    return formatted.select("conv_id", "formatted", "starts", "ends", "mask").mapInArrow(_read_back, DIGESTS)


def _read_back(batches):
    import hashlib

    import pyarrow as pa

    names = [f.split()[0] for f in DIGESTS.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in DIGESTS.split(", ")]
    done, state, conv = [], None, None

    def close():
        if state is not None:
            n, turns, chars, loss, formatted, tokens, trained = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens, trained))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    for b in batches:
        for c, text, starts, ends, mask in zip(*(b.column(i).to_pylist() for i in range(5))):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for part in masked_text(text, starts, ends, mask):
                state[2] += len(part)
                state[3].update(part.encode())
            state[4] += len(text)
            state[5] += len(mask)
            state[6] += sum(mask)
        if len(done) > 1000:
            yield batch()
            done.clear()
    close()
    if done:
        yield batch()
