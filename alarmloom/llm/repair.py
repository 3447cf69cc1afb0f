"""Conversation structure repair by Hirschberg's divide and conquer.

Turns are kept, re-labelled, deleted or joined by inserted empty turns, at least cost, until their role initials read
``(s?(ua)+)?``; of the cheapest edits those whose initials are least in ASCII order are taken. Four states say what was
written last (nothing, system, user, assistant). A row, with the insertions before it, is a step from state to state. To repair
a run of rows between two known states, a forward vector of four costs runs up to the middle and a backward one down to it; the
state with the least sum is the crossing, and both halves are repaired alone: space is linear, no table of rows by states is kept.

Ties. A row adds one letter besides the insertions before it, so that no least audit of a prefix is the beginning of another
one. The forward vector therefore carries the order of its four audits next to the costs, and the least one among
optimal crossings is part of the least audit of all.

On Spark the first divisions are made between tasks. Rows are range-partitioned by conversation, turn, role and text, sorted, and
cut into chunks of at most ``CHUNK_ROWS`` rows or ``CHUNK_CHARS`` characters; a chunk is a step like a row, a table of costs and
orders between its ends. Chunks of a conversation that has several are composed ``FAN`` at a time up to the conversation and
their crossings handed down again, so that a conversation with a third of all rows is repaired by many tasks. Only the hash of
such a conversation's text has to be read in order by one task, as a stream.

Faults, the first counts: blank (only white space), duplicate (role and text seen earlier in the conversation, compared by 128 bits
of hash), truncated (the last character that is not white space is none of ``.!?``). Rows of one turn are ordered by role and
text, null turns come first; repeated rows are turns of their own, counted before they are sorted. Null roles and texts are one
space (such texts are blank; such roles, and empty ones, fit nowhere); rows of a null conversation id are one conversation. A conversation without
rows gives no row; no rows give no rows. Other columns are not read. Gaps beyond 64 bits count as the largest long.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from .common import col, share_join, tune

CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 20
FAN_BITS = 12
PREFIX = 256
SMALL = 4 * 1024 * 1024
SPACE = " \t\n\v\f\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
INITIALS = "sua"
# States by what was written last; insertions that end a conversation in each state.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDING = ("", "II", "I", "")
FINE, CUT, GONE = range(3)
_INF = 1 << 50


def _after(state: int, initial: str) -> int | None:
    """The state after a turn with this initial is written, if it may be."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return USER if initial == "u" and state != USER else None


def _role(state: int) -> str:
    """The only role besides system that may follow."""
    return "assistant" if state == USER else "user"


def _letters(initial: str, kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest and then least letters of a row, insertions first, between every two states."""
    best: dict = {}
    for start in range(4):
        state, cost, said = start, 0, ""
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if kind != GONE:
                more = TRUNCATED if kind == CUT else 0
                ways.append((_after(state, _role(state)[0]), REROLE + more, "R"))
                if _after(state, initial) is not None:
                    ways.append((_after(state, initial), KEEP + more, "K"))
            for end, price, letter in ways:
                way = (cost + price, said + letter)
                best[start, end] = min(best.get((start, end), way), way)
            state, cost, said = _after(state, _role(state)[0]), cost + INSERT, said + "I"
    return best


# A row's step is its place here: three kinds for every initial, the last one for any other.
LETTERS = [_letters(i, kind) for i in [*INITIALS, ""] for kind in range(3)]


def _ranked(ways: dict[tuple[int, int], tuple[int, str]]) -> tuple:
    """(start, end, cost, order among the ends of a start)."""
    order = {x: sorted(said for (s, _), (_, said) in ways.items() if s == x) for x in range(4)}
    return tuple((x, y, cost, order[x].index(said)) for (x, y), (cost, said) in sorted(ways.items()))


_STEPS = [_ranked(ways) for ways in LETTERS]


def _ways(step) -> tuple:
    return _STEPS[step] if isinstance(step, int) else step


@lru_cache(maxsize=1 << 16)
def _forward(costs: tuple, ranks: tuple, step) -> tuple:
    """Least costs after the step less their minimum, the order of their audits, and that minimum."""
    best: list = [None] * 4
    for x, y, cost, rank in _ways(step):
        if costs[x] < _INF:
            way = (costs[x] + cost, ranks[x], rank)
            best[y] = way if best[y] is None or way < best[y] else best[y]
    least = min(b[0] for b in best if b)
    order = sorted({b[1:] for b in best if b})
    return (tuple(b[0] - least if b else _INF for b in best), tuple(order.index(b[1:]) if b else 0 for b in best), least)


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple, step) -> tuple:
    best = [_INF] * 4
    for x, y, cost, _ in _ways(step):
        best[x] = min(best[x], cost + costs[y])
    least = min(best)
    return tuple(b - least if b < _INF else _INF for b in best)


def ahead(steps, x: int) -> tuple[tuple, tuple, int]:
    """Relative costs, orders and the least cost after all steps from state x."""
    costs, ranks, total = tuple(0 if s == x else _INF for s in range(4)), (0, 0, 0, 0), 0
    for step in steps:
        costs, ranks, least = _forward(costs, ranks, step)
        total += least
    return costs, ranks, total


def composed(steps) -> tuple:
    """All steps as one."""
    out = []
    for x in range(4):
        costs, ranks, total = ahead(steps, x)
        out += [(x, y, total + costs[y], ranks[y]) for y in range(4) if costs[y] < _INF]
    return tuple(out)


def last_state(steps, x: int = NOTHING) -> int:
    """The state after the last step of the best repair, before insertions at the end."""
    costs, ranks, _ = ahead(steps, x)
    return min((costs[s] + INSERT * len(ENDING[s]), ranks[s], s) for s in range(4) if costs[s] < _INF)[2]


def crossings(steps, x: int, y: int) -> list[int]:
    """The state after every step of the cheapest and then least way from state x to state y."""
    out = [y] * len(steps)
    todo = [(0, len(steps), x, y)]
    while todo:
        lo, hi, x, y = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        costs, ranks, _ = ahead(steps[lo:mid], x)
        back = tuple(0 if s == y else _INF for s in range(4))
        for i in range(hi - 1, mid - 1, -1):
            back = _backward(back, steps[i])
        s = min((costs[s] + back[s], ranks[s], s) for s in range(4) if costs[s] < _INF and back[s] < _INF)[2]
        out[mid - 1] = s
        todo += [(lo, mid, x, s), (mid, hi, s, y)]
    return out


def rebuilt(turns: list[tuple[str, str]], steps, times, x: int, y: int | None, ends: bool):
    """(audit, cost, repaired turns) of the rows of a chunk."""
    y = last_state(steps, x) if y is None else y
    audit, cost, out = [], 0, []
    for (role, text), step, many, to in zip(turns, steps, times, crossings(steps, x, y)):
        price, letters = LETTERS[step][x, to]
        for letter in letters:
            if letter != "D":
                name = role if letter == "K" else _role(x)
                out.append((name, "" if letter == "I" else text))
                x = _after(x, name[0])
        audit.append(letters + "D" * (many - 1))
        cost += price + DELETE * (many - 1)
    if ends:
        audit.append(ENDING[x])
        cost += INSERT * len(ENDING[x])
        for _ in ENDING[x]:
            out.append((_role(x), ""))
            x = _after(x, _role(x)[0])
    return "".join(audit), cost, out


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a checksum of conversation and turn chooses; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        copies.alias("copy")).drop("copy")


def faulty(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, times, fault): distinct rows, how often each occurs, and the fault of its first copy."""
    space = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    rows = turns.select(col(conv_col).cast("long").alias("conv"), col(turn_col).cast("long").alias("turn"),
                        space(role_col).alias("role"), space(text_col).alias("text"))
    said = (F.isnull("conv"), "conv", "role", F.lit("\0"), "text")
    place = F.struct(F.isnotnull("turn").cast("int").alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    rows = rows.select("*", F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit(1), *said).alias("h2"), place.alias("place"))
    again = durable(rows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repair")
    seen = share_join(rows, again, ["h1", "h2"], "left", SMALL).select(
        "conv", "turn", "role", "text", F.isnull("n").alias("once"), F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))
    one = seen.filter("once").select("conv", "turn", "role", "text", "later", F.lit(1).cast("long").alias("times"))
    more = seen.filter("not once").groupBy("conv", "turn", "role", "text", "later").agg(F.count(F.lit(1)).alias("times"))
    core = F.translate("text", SPACE, "")
    fault = F.when(core == "", "blank").when(F.col("later"), "duplicate").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated")
    return one.unionByName(more).select("conv", "turn", "role", "text", "times", fault.alias("fault"))


_CHUNKS = ("conv long, seq long, whole boolean, turns array<struct<role:string,text:string>>, steps array<int>, times array<long>, "
           "way array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "turn_min long, turn_max long, n_turns long")


class _Chunk:
    def __init__(self, conv):
        self.conv, self.turns, self.steps, self.times, self.chars = conv, [], [], [], 0
        self.found = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.low = self.high = None
        self.distinct = 0

    def add(self, turn, role, text, times, fault):
        found, initial = self.found, role[:1]
        if fault in ("blank", "duplicate"):
            found[fault] += times
        else:
            found["duplicate"] += times - 1
            found["truncated"] += fault == "truncated"
        found["illegal"] += illegal(initial, initial) * (times - 1) + (self.first is not None and illegal(self.last, initial))
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += 1
        kind = {None: FINE, "truncated": CUT}.get(fault, GONE)
        at = INITIALS.find(initial) if initial else -1
        self.steps.append(3 * (at if at >= 0 else 3) + kind)
        self.turns.append({"role": role, "text": text})
        self.times.append(times)
        self.chars += len(text) + len(role)

    def row(self, seq: int, whole: bool) -> tuple:
        way = None if whole else [v for w in composed(self.steps) for v in w]
        return (self.conv, seq, whole, self.turns, self.steps, self.times, way, *self.found.values(), self.first, self.last,
                self.low, self.high, self.distinct)


def illegal(a: str, b: str) -> int:
    return int(a + b not in ("su", "ua", "au"))


class _Cut:
    """Sorted rows of a partition to chunks; a conversation that other partitions may hold rows of, or that has several chunks,
    is not whole."""

    def __init__(self, rows: int, chars: int):
        self.rows, self.chars = rows, chars

    def chunks(self, batches):
        """(chunk, whether it is a whole conversation)."""
        chunk, inner, alone = None, False, True
        for b in batches:
            for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
                if chunk is None:
                    chunk = _Chunk(conv)
                elif conv != chunk.conv:
                    yield chunk, inner and alone
                    chunk, inner, alone = _Chunk(conv), True, True
                elif len(chunk.steps) >= self.rows or chunk.chars >= self.chars:
                    yield chunk, False
                    chunk, alone = _Chunk(conv), False
                chunk.add(*row)
        if chunk is not None:
            yield chunk, False

    def __call__(self, batches):
        from pyspark import TaskContext

        part, rows, size = TaskContext.get().partitionId() << 31, [], 0
        for i, (chunk, whole) in enumerate(self.chunks(batches)):
            rows.append(chunk.row(part | i, whole))
            size += chunk.chars
            if size >= self.chars or len(rows) >= 1000:
                yield _batch(rows, _CHUNKS)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _CHUNKS)


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    kinds["array<struct<role:string,text:string>>"] = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _steps(table) -> list[tuple]:
    flat = table.column("way").to_pylist()
    return [tuple(tuple(w[i:i + 4]) for i in range(0, len(w), 4)) for w in flat]


def _compose(key, table):
    """One node from its children."""
    import pyarrow as pa

    table = table.sort_by("seq")
    way = [v for w in composed(_steps(table)) for v in w]
    return pa.table([table.column("conv").slice(0, 1), table.column("up").slice(0, 1), pa.array([way], pa.list_(pa.int64()))],
                    ["conv", "seq", "way"])


def _hand_down(key, table):
    """Crossings between the children of one node; the topmost node starts from nothing and ends the conversation."""
    import pyarrow as pa

    table = table.sort_by("seq")
    steps = _steps(table)
    x, y, ends = (table.column(c)[0].as_py() for c in ("x", "y", "ends"))
    y = last_state(steps, x) if y is None else y
    states = crossings(steps, x, y)
    last = [False] * (len(steps) - 1) + [ends]
    return pa.table([table.column("conv"), table.column("seq"), pa.array([x, *states[:-1]], pa.int32()), pa.array(states, pa.int32()),
                     pa.array(last)], ["conv", "seq", "x", "y", "ends"])


_STATES = "conv long, seq long, x int, y int, ends boolean"


def boundary_states(nodes: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """``_STATES`` of the nodes (conv, seq, way): the states at their ends. A task composes at most 2 ** fan_bits of them."""
    most = nodes.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    top = [F.lit(NOTHING).alias("x"), F.lit(None).cast("int").alias("y"), F.lit(True).alias("ends")]
    if most <= 1 << fan_bits:
        return durable(nodes.select("*", *top).groupBy("conv").applyInArrow(_hand_down, _STATES), "repair")
    inner = nodes.withColumn("up", F.shiftright("seq", fan_bits))
    parents = durable(inner.groupBy("conv", "up").applyInArrow(_compose, "conv long, seq long, way array<long>"), "repair")
    above = boundary_states(parents, fan_bits).toDF("of", "above", "x", "y", "ends")
    met = inner.join(above, inner["conv"].eqNullSafe(above["of"]) & (F.col("up") == F.col("above"))).drop("of", "above")
    return durable(met.groupBy("conv", "up").applyInArrow(_hand_down, _STATES), "repair")


_REPAIRED = ("conv long, seq long, whole boolean, audit string, cost long, turns array<struct<role:string,text:string>>, blank long, "
             "duplicate long, truncated long, illegal long, first string, last string, turn_min long, turn_max long, n_turns long")


def _rebuild(batches):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            whole = r["whole"]
            audit, cost, out = rebuilt([(t["role"], t["text"]) for t in r["turns"]], r["steps"], r["times"],
                                       NOTHING if whole else r["x"], None if whole else r["y"], whole or r["ends"])
            rows.append((r["conv"], r["seq"], whole, audit, cost, [{"role": a, "text": t} for a, t in out],
                         *(r[c] for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "turn_min", "turn_max", "n_turns"))))
        if rows:
            yield _batch(rows, _REPAIRED)


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS, fan_bits: int = FAN_BITS,
) -> DataFrame:
    """``_REPAIRED`` rows, one a chunk: audit, cost and repaired turns in the order of ``seq``, and what was wrong."""
    tune(turns.sparkSession)
    rows = faulty(turns, conv_col, turn_col, role_col, text_col)
    keys = ["conv", "turn", "role"]
    rows = rows.repartitionByRange(*keys, F.substring("text", 1, PREFIX)).sortWithinPartitions(*keys, "text")
    chunks = durable(rows.select(*keys, "text", "times", "fault").mapInArrow(_Cut(chunk_rows, chunk_chars), _CHUNKS), "repair")
    states = boundary_states(chunks.filter("not whole").select("conv", "seq", "way"), fan_bits)
    named = share_join(chunks, states.drop("conv").withColumn("n", F.lit(1)), ["seq"], "left", SMALL)
    return named.drop("way", "n").mapInArrow(_rebuild, _REPAIRED)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, seq, place, role, text): the turns of the repaired conversations; seq and place give their order."""
    return repaired.select(F.col("conv").alias("conv_id"), "seq", F.posexplode("turns").alias("place", "t")).select(
        "conv_id", "seq", "place", "t.role", "t.text")


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def reports(repaired: DataFrame) -> DataFrame:
    """One ``_REPORT`` row per conversation; chunks of one conversation are read in order, as a stream."""
    whole = repaired.filter("whole")
    parts = repaired.filter("not whole").repartition("conv").sortWithinPartitions("conv", "seq")
    return whole.unionByName(parts).mapInArrow(_report, _REPORT)


def _report(batches):
    import hashlib

    done, conv, state = [], None, None

    def close():
        if state is not None:
            low, high, n = state["low"], state["high"], state["n"]
            gaps = 0 if low is None else min(high - low + 1 - n, 2**63 - 1)
            done.append((conv, gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["cost"],
                         "".join(state["audit"]), state["text"].hexdigest()))

    for b in batches:
        for r in b.to_pylist():
            if state is None or r["whole"] or r["conv"] != conv:
                close()
                conv = r["conv"]
                state = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "text": hashlib.sha256(),
                         "low": None, "high": None, "n": 0, "last": None, "some": False}
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                state[c] += r[c]
            state["illegal"] += state["last"] is not None and illegal(state["last"], r["first"])
            state["last"] = r["last"]
            if r["turn_min"] is not None:
                state["n"] += r["n_turns"] - (state["high"] == r["turn_min"])
                state["low"], state["high"] = r["turn_min"] if state["low"] is None else state["low"], r["turn_max"]
            state["audit"].append(r["audit"])
            for t in r["turns"]:
                state["text"].update((("\n" if state["some"] else "") + t["role"] + ":" + t["text"]).encode())
                state["some"] = True
        if len(done) > 1000:
            yield _batch(done, _REPORT)
            done.clear()
    close()
    if done:
        yield _batch(done, _REPORT)
