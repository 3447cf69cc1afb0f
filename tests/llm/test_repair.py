import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alarmloom.llm import queries, repair

LEGAL = re.compile("(s?(ua)+)?")
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """The contract's damage, in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        core = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_edits(turns, found):
    """Least (cost, audit, repaired) over every way to edit."""
    best = None

    def walk(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in out)):
            return
        if i == len(turns):
            for more in ([], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")]):
                done = out + more
                if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in done)):
                    best = min(filter(None, (best, (cost + 3 * len(more), audit + "I" * len(more), done))), key=lambda b: b[:2])
            return
        (_, role, text), fault = turns[i], found[i]
        for n in range(3):
            for added in product(["user", "assistant"], repeat=n):
                was = out + [(a, "") for a in added]
                price, said = cost + 3 * n, audit + "I" * n
                walk(i + 1, price + 4, said + "D", was)
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 * (fault == "truncated")
                walk(i + 1, price + more, said + "K", [*was, (role, text)])
                for name in ("user", "assistant"):
                    walk(i + 1, price + 3 + more, said + "R", [*was, (name, text)])

    walk(0, 0, "", [])
    return best


def table_edits(turns, found):
    """The same by a table of states that keeps whole audits; for conversations that are too long for ``all_edits``."""
    state = {"": (0, "", [])}
    symbol = {"": "u", "s": "u", "a": "u", "u": "a"}
    name = {"u": "user", "a": "assistant"}

    def better(to, key, way):
        if key not in to or way[:2] < to[key][:2]:
            to[key] = way

    for (_, role, text), fault in zip(turns, found):
        new = {}
        for s, way in state.items():
            for _ in range(3):
                cost, audit, out = way
                better(new, s, (cost + 4, audit + "D", out))
                if fault not in ("blank", "duplicate"):
                    more, n = 3 * (fault == "truncated"), symbol[s]
                    better(new, n, (cost + 3 + more, audit + "R", [*out, (name[n], text)]))
                    if role[:1] == n or (role[:1] == "s" and s == ""):
                        better(new, role[:1], (cost + more, audit + "K", [*out, (role, text)]))
                way, s = (cost + 3, audit + "I", [*out, (name[symbol[s]], "")]), symbol[s]
        state = new
    ends = {"": 0, "s": 2, "u": 1, "a": 0}
    tails = {"s": [("user", ""), ("assistant", "")], "u": [("assistant", "")]}
    return min(((c + 3 * ends[s], a + "I" * ends[s], o + tails.get(s, [])) for s, (c, a, o) in state.items()), key=lambda b: b[:2])


def expected(rows, edits, breaks=True):
    turns = defaultdict(list)
    for conv, turn, role, text in damaged(rows) if breaks else rows:
        turns[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(turns[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        found = faults(own)
        known = {t for t, _, _ in own if t is not None}
        heads = [r[:1] for _, r, _ in own]
        cost, audit, done = edits(own, found)
        said = "\n".join(f"{r}:{t}" for r, t in done)
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
                     hashlib.sha256(said.encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


turn = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "Ua"]), st.sampled_from(["", " \n", "yes.", "no", "why? ", "é"]))


@settings(max_examples=250, deadline=None)
@given(st.lists(turn, max_size=4))
def test_least_of_all_edits(rows):
    turns = [(i, r, t) for i, (r, t) in enumerate(rows)]
    found = faults(turns)
    steps = [3 * (repair.INITIALS.find(r[0]) % 4 if r else 3) + {None: 0, "truncated": 1}.get(f, 2) for (_, r, _), f in zip(turns, found)]
    audit, cost, out = repair.rebuilt([t[1:] for t in turns], steps, [1] * len(turns), repair.NOTHING, None, True)
    assert (cost, audit, out) == all_edits(turns, found) == table_edits(turns, found)


@settings(max_examples=60, deadline=None)
@given(st.lists(turn, min_size=1, max_size=60), st.integers(1, 7))
def test_composed_chunks_give_the_same(rows, size):
    turns = [(i, r, t) for i, (r, t) in enumerate(rows)]
    found = faults(turns)
    steps = [3 * (repair.INITIALS.find(r[0]) % 4 if r else 3) + {None: 0, "truncated": 1}.get(f, 2) for (_, r, _), f in zip(turns, found)]
    parts = [steps[i:i + size] for i in range(0, len(steps), size)]
    ways = [repair.composed(p) for p in parts]
    states = repair.crossings(ways, repair.NOTHING, repair.last_state(ways))
    audit, cost, at, x = "", 0, 0, repair.NOTHING
    for k, (p, y) in enumerate(zip(parts, states)):
        a, c, _ = repair.rebuilt([t[1:] for t in turns[at:at + len(p)]], p, [1] * len(p), x, y, k == len(parts) - 1)
        audit, cost, at, x = audit + a, cost + c, at + len(p), y
    assert (cost, audit) == table_edits(turns, found)[:2]


def test_query_is_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows, table_edits)
    assert got(queries.op13_conversation_repair(spark, sf)) == want
    short = {c for c, n in ((c, sum(r[0] == c for r in rows)) for c in want) if n <= 4}
    assert {c: want[c] for c in short} == expected([r for r in rows if r[0] in short], all_edits)


SCHEMA = "conv_id long, turn long, role string, text string, conv string, times string, fault string, place string"


@pytest.mark.parametrize("rows,chars,bits", [(repair.CHUNK_ROWS, repair.CHUNK_CHARS, repair.FAN_BITS), (2, 1 << 20, 1), (100, 3000, 2)])
def test_odd_rows(spark, rows, chars, bits):
    data = [(1, None, None, None), (1, None, "user", "a."), (1, 3, "assistant", None), (1, 3, "assistant", None), (1, 3, "user", "b"),
            (None, 2, "system", "rules."), (None, 2, "system", "rules."), (None, 5, "user", "x" * 5000), (None, 9, "assistant", "fine."),
            (2, 1, "", "text."), (3, 1, "user", " \t"), (4, -2**63, "user", "q?"), (4, 2**63 - 1, "assistant", "r."),
            (5, 0, "assistant", "late."), (5, 1, "user", "late."), (5, 2, "assistant", "late.")]
    data += [(6, i, ["user", "assistant", "tool", "system"][i * i % 7 % 4], ["yes.", "no", f"word {i}."][i % 3]) for i in range(400)]
    data += [(7, 0, "user", "same.")] * 50
    df = spark.createDataFrame([(*r, *["c"] * 4) for r in data], SCHEMA).repartition(7)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in data]
    want = expected(plain, table_edits, breaks=False)
    want[4] = (2**63 - 1, *want[4][1:])
    made = repair.repair(df, chunk_rows=rows, chunk_chars=chars, fan_bits=bits)
    assert got(repair.reports(made)) == want
    turns = defaultdict(list)
    for r in repair.repaired_turns(made).collect():
        turns[r["conv_id"]].append((r["seq"], r["place"], r["role"]))
    assert all(LEGAL.fullmatch("".join(r[:1] for *_, r in sorted(t))) for t in turns.values())


def test_no_rows(spark):
    assert repair.reports(repair.repair(spark.createDataFrame([], SCHEMA))).count() == 0
