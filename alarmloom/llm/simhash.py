"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has one bit for every bit of a 64-bit hash: set if it is set in more than half of the text's
word shingles. Two fingerprints link at ``DISTANCE`` = 2 or fewer differing bits. Fingerprints are cut into two
segments, so that at least one of them differs by at most one bit; for every segment and every bit of it the
segment without that bit is indexed, and fingerprints that meet under a key are verified. Equal
fingerprints are one fingerprint throughout, so that copies cost nothing.

A key that more than ``PAIRED`` fingerprints share is not paired off. Its fingerprints are known to agree on the
segment but for the wildcard, so a second wildcard (two, where the segment is equal) in the other segment makes
keys under which all fingerprints are within the distance by construction, and each links to the least one:
rows grow in proportion to the fingerprints, and no link is lost. Links are joined to components by
alternating star rounds.

Words are runs without white space, compared without the case of A to Z; texts of fewer words than a shingle are one
shingle; wordless and null texts have fingerprint zero and link like any other. A null id is the least id.
Repeated rows get equal rows; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..runtime import durable
from .common import NULL_ID, col, share_join, tune

SHINGLE = 3
SEED = 42
DISTANCE = 2
HALF = 32
PAIRED = 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    h = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(stops)
    for at in range(0, n, 8192):
        part = [h(joined[s:e], SEED) for s, e in zip(starts[at:at + 8192], stops[at:at + 8192])]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


class _Prints:
    def __init__(self, shingle: int):
        self.shingle = shingle

    def __call__(self, batches):
        import pyarrow as pa

        for b in batches:
            made = np.array([fingerprint(t, self.shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(made)], ["doc_id", *b.schema.names[2:], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, rhash, fp): fingerprints as signed 64-bit integers; ``rhash`` is a hash of the text."""
    tune(docs.sparkSession)
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("rhash"))
    return rows.mapInArrow(_Prints(shingle), "doc_id long, rhash long, fp long")


def _segment(fp: Column, s: Column) -> Column:
    """Segment 0 (low bits) or 1 (high bits) as a non-negative long."""
    return F.when(s == 0, fp.bitwiseAND(F.lit((1 << HALF) - 1))).otherwise(F.shiftrightunsigned(fp, HALF))


def _without(segment: Column, bit: Column) -> Column:
    return segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def variants(prints: DataFrame) -> DataFrame:
    """(key, s, i, fp): both segments without each of their bits."""
    at = F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1)))
    rows = prints.select("fp", at.alias("p")).select(
        "fp", F.floor(F.col("p") / HALF).cast("int").alias("s"), (F.col("p") % HALF).alias("i"))
    rest = _without(_segment(F.col("fp"), F.col("s")), F.col("i"))
    place = (F.col("s") * HALF + F.col("i")).cast("long")
    return rows.select(F.shiftleft(place, HALF).bitwiseOR(rest).alias("key"), "s", "i", "fp")


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within the distance do; ``prints`` (fp) is distinct."""
    index = variants(prints)
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark sizes what an explode repeats like the rows before it, so it would broadcast these lookups
    met = durable(index.join(shared.hint("merge"), "key"), "simhash")
    few = met.filter(F.col("n") <= paired).select("key", "s", "i", "fp")
    x = few.select("key", "s", "i", F.col("fp").alias("a"))
    y = few.select("key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # pairs that agree on the whole segment meet under all of its keys; the first one counts
    here = (F.getbit(differ, F.col("s") * HALF + F.col("i")) == 1) | (F.col("i") == 0)
    pairs = x.join(y.hint("merge"), "key").filter((F.col("a") < F.col("b")) & here & (F.bit_count(differ) <= DISTANCE)).select("a", "b")
    return pairs.unionByName(crowded_links(met.filter(F.col("n") > paired))).distinct()


def crowded_links(met: DataFrame) -> DataFrame:
    """Links under keys with many fingerprints: to the least one under each key with a second wildcard."""
    other = _segment(F.col("fp"), 1 - F.col("s"))
    one = met.select("key", "fp", other.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("j")).select(
        "fp", F.struct("key", F.col("j").alias("j"), F.lit(-1).cast("long").alias("k"), _without(F.col("o"), F.col("j")).alias("v")).alias("w"))
    two_bits = [(j, k) for j in range(HALF) for k in range(j)]
    masks = F.explode(F.array(*[F.lit(~((1 << j) | (1 << k)) & ((1 << HALF) - 1)).cast("long") for j, k in two_bits]))
    two = met.filter("i = 0").select("fp", "s", _segment(F.col("fp"), F.col("s")).alias("whole"), other.alias("o"), masks.alias("m")).select(
        "fp", F.struct(F.col("whole").alias("key"), F.col("s").alias("j"), F.col("m").alias("k"),
                       F.col("o").bitwiseAND(F.col("m")).alias("v")).alias("w"))
    rows = one.unionByName(two)
    least = rows.groupBy("w").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(least.select("w", "a").hint("merge"), "w").filter("a < fp").select("a", F.col("fp").alias("b"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rhash, fp, component_id) of every row; ``component_id`` is the least id that links reach."""
    prints = durable(fingerprints(docs, id_col, text_col), "simhash")
    ident = F.coalesce("doc_id", F.lit(NULL_ID))
    distinct = durable(prints.groupBy("fp").agg(F.min(ident).alias("least"), F.count(F.lit(1)).alias("n")), "simhash")
    joined = durable(links(distinct.select("fp")), "simhash")
    edges = joined.select(F.lit(0).alias("graph"), F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = distinct.select(F.lit(0).alias("graph"), F.col("fp").alias("id"))
    comp = connected_components(edges, nodes).select(F.col("id").alias("fp"), "comp")
    by_print = distinct.join(comp.hint("merge"), "fp")
    least = by_print.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_print = durable(by_print.join(least.hint("merge"), "comp").select("fp", "component_id", "n"), "simhash")
    return share_join(prints, of_print, ["fp"]).select("doc_id", "rhash", "fp", F.when(
        F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"))
