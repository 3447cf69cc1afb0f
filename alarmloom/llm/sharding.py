"""Shards of near-equal bytes by a histogram sort.

Rows are ordered by a key of hexadecimal digits: hash of the text, hash of the id, position. Candidate
boundaries are the prefixes of that key: bytes below every prefix are counted exactly across all partitions,
and only the prefixes around a wanted cut are refined by further digits, until the cut lies within the
tolerance. Then the rows are exchanged once. Equal texts stay together unless a cut has to go through them;
since the last digits differ for every row, even a third of equal rows can be cut.

Inside a shard the rows are dealt by a hash of their key to pieces of about ``PIECE_BYTES``, so that no task
gets a whole shard; a slot is the number of rows in earlier pieces plus the rank in its own. Null texts count no
bytes of text, null ids are ordinary ids, no rows give no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import durable, lookup_join
from .common import col, fresh, tune

ROW_BYTES = 8
PIECE_BYTES = 128 * 1024 * 1024
LEAST_PIECES = 8
DIGITS = 3


def row_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def sort_key(text: Column, ident: Column) -> Column:
    hexed = [F.lpad(F.lower(F.hex(c)), 16, "0") for c in (
        F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(ident), F.monotonically_increasing_id())]
    return F.concat(*hexed)


def splitters(rows: DataFrame, shards: int, tolerance: float) -> tuple[list[str], int]:
    """Cuts of ``rows`` (key, size) into ``shards`` parts, and the total size.

    Each round counts the bytes below all children of the prefixes that still hold a wanted cut: at most
    4 096 x (shards - 1) sums reach the driver."""
    total, wanted, cuts = None, {}, {}
    active, width = None, 0
    while active is None or active:
        width += DIGITS
        level = rows if active is None else rows.filter(F.substring("key", 1, width - DIGITS).isin(list(active)))
        sums = level.groupBy(F.substring("key", 1, width).alias("p")).agg(F.sum("size").alias("b")).collect()
        children: dict[str, list] = {}
        for r in sorted(sums, key=lambda r: r["p"]):
            children.setdefault(r["p"][: width - DIGITS], []).append((r["p"], r["b"]))
        if active is None:
            total = sum(r["b"] for r in sums)
            if not total:
                return [], 0
            wanted = {i: (total * i / shards, "", 0) for i in range(1, shards)}
        spare, active = tolerance * total / shards, set()
        for i, (target, prefix, below) in list(wanted.items()):
            parts = children[prefix]
            sizes, at = [], below
            for _, b in parts:
                at += b
                sizes.append(at)
            j = min(bisect.bisect_left(sizes, target), len(parts) - 1)
            before = sizes[j] - parts[j][1]
            after = parts[j + 1][0] if j + 1 < len(parts) else parts[j][0] + "g"  # above every digit
            if target - before <= spare or sizes[j] - target <= spare or width >= 48:
                cuts[i] = parts[j][0] if target - before <= sizes[j] - target else after
                del wanted[i]
            else:
                wanted[i] = (target, parts[j][0], before)
                active.add(parts[j][0])
    return [cuts[i] for i in sorted(cuts)], total


def histogram_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002,
) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot`` (with underscores before them where taken).

    ``tolerance``: how far a cut may be from its ideal place, as a share of a shard's bytes; a cut is never
    finer than one row."""
    tune(docs.sparkSession)
    key, size, salt, base, shard, slot = fresh(docs.columns, "key", "size", "salt", "base", "shard", "slot")
    # written once: the positions in the key must be the same in every later pass
    keyed = durable(docs.withColumns({key: sort_key(col(text_col), col(id_col)), size: row_bytes(col(text_col))}), "shard")
    narrow = keyed.select(col(key).alias("key"), col(size).alias("size"))
    cuts, total = splitters(narrow, shards, tolerance)
    pieces = max(LEAST_PIECES, -(-total // (shards * PIECE_BYTES)))

    def place(k: Column) -> list[Column]:
        s = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= k)) if cuts else F.lit(0)
        return [s.cast("int").alias(shard), F.pmod(F.xxhash64(k), F.lit(pieces)).cast("int").alias(salt)]

    counts = narrow.select(*place(F.col("key"))).groupBy(shard, salt).agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(shard).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(shard, salt, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(base))
    placed = keyed.select("*", *place(F.col(key)))
    rank = F.row_number().over(W.partitionBy(shard, salt).orderBy(key)) - 1
    ranked = placed.withColumn(slot, rank.cast("long"))
    out = lookup_join(ranked, bases, [shard, salt], [key], rows_in_lookup=shards * pieces)
    return out.select(*map(col, docs.columns), shard, (F.col(slot) + F.col(base)).alias(slot))
