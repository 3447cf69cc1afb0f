"""Packets to flows to flow markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW = ["pcap_path", "ip1", "p1", "ip2", "p2", "proto"]
# Marker defaults.
LENGTH_SHIFT, MAX_LENGTH = 4, 1500
GAP_SHIFT, MAX_GAP_MS = 6, 3_600_000
BENIGN_CLASSES = ("benign", "normal", "Benign", "BENIGN")
MAX_PACKETS = 256


def length_bins(shift: int = LENGTH_SHIFT, longest: int = MAX_LENGTH) -> int:
    return -(-longest // (1 << shift))


def gap_bins(shift: int = GAP_SHIFT) -> int:
    return -(-MAX_GAP_MS // (1 << shift))


def usable_packets(packets: DataFrame) -> DataFrame:
    """TCP and UDP packets with their IP length, or the frame length where it is missing."""
    return packets.filter(F.col("proto").isin(6, 17)).withColumn(
        "len", F.coalesce("ip_len", "frame_len"))


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Order the two endpoints so that both directions share a key."""
    a = F.struct("src_ip", "sport")
    b = F.struct(F.col("dst_ip").alias("src_ip"), F.col("dport").alias("sport"))
    first = a <= b
    return packets.select(
        "*", F.when(first, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("ip1"),
        F.when(first, F.col("sport")).otherwise(F.col("dport")).alias("p1"),
        F.when(first, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ip2"),
        F.when(first, F.col("dport")).otherwise(F.col("sport")).alias("p2"))


def flows(packets: DataFrame) -> DataFrame:
    """One row per flow: packet count, first and last time, bytes."""
    return packets.groupBy(*FLOW).agg(
        F.count("*").alias("packets"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(F.col("len").cast("long")).alias("bytes"))


def length_bin(c: Column, shift: int = LENGTH_SHIFT, longest: int = MAX_LENGTH) -> Column:
    return F.least(F.shiftright(F.least(c, F.lit(longest)), shift),
                   F.lit(length_bins(shift, longest) - 1))


def length_histogram(
    packets: DataFrame, shift: int = LENGTH_SHIFT, longest: int = MAX_LENGTH
) -> DataFrame:
    """(flow, pl): dense packet-length counts; one hash aggregate with a counter per bin."""
    n = length_bins(shift, longest)
    binned = packets.select(*FLOW, length_bin(F.col("len"), shift, longest).alias("_b"))
    # counting per (flow, bin) first keeps a hot flow's packets on the map side
    per = binned.groupBy(*FLOW, "_b").agg(F.count("*").alias("_c"))
    cells = per.groupBy(*FLOW).agg(F.map_from_entries(
        F.collect_list(F.struct("_b", "_c"))).alias("_m"))  # at most n entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long")))
    return cells.select(*FLOW, dense.alias("pl"))


def gap_counts(
    packets: DataFrame, shift: int = GAP_SHIFT, piece_seconds: float = 60.0
) -> DataFrame:
    """(flow, gap_bin, n): sparse inter-arrival counts between consecutive packets.

    A flow is cut into short pieces of time before it is sorted, so a flow with a third of all
    packets is spread over tasks; the gap between two pieces is taken from the piece edges.
    """
    w = Window.partitionBy(*FLOW, "_piece").orderBy("ts")
    timed = packets.select(*FLOW, "ts", F.floor(F.col("ts") / F.lit(piece_seconds)).alias("_piece"))
    inner = timed.select(*FLOW, (F.col("ts") - F.lag("ts").over(w)).alias("_dt"))
    edges = timed.groupBy(*FLOW, "_piece").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    across = Window.partitionBy(*FLOW).orderBy("_piece")
    outer = edges.select(*FLOW, (F.col("a") - F.lag("b").over(across)).alias("_dt"))
    ms = F.col("_dt") * F.lit(1000.0)
    last = gap_bins(shift) - 1
    b = F.when(ms > MAX_GAP_MS, F.lit(last)).otherwise(
        F.least(F.shiftright(ms.cast("long"), shift).cast("int"), F.lit(last)))
    gaps = inner.unionByName(outer).filter(F.col("_dt") >= 0)
    return gaps.groupBy(*FLOW, b.alias("gap_bin")).agg(F.count("*").alias("n"))


def gap_histogram(packets: DataFrame, shift: int = GAP_SHIFT) -> DataFrame:
    """(flow, ipt): sparse map bin -> count; logical size ``gap_bins``, empty for one packet."""
    every = packets.select(*FLOW).distinct().select("*", F.lit(None).cast("int").alias("gap_bin"), F.lit(None).cast("long").alias("n"))
    entry = F.when(F.col("gap_bin").isNotNull(), F.struct("gap_bin", "n"))
    return gap_counts(packets, shift).unionByName(every).groupBy(*FLOW).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("ipt"))


def dense_counts(counts: str, n: int) -> Column:
    """Array of ``n`` counts from a map of bins in rising order, or null for none: runs of zeros and the counts between them, so
    that a bin is looked at once and no map is searched."""
    entry = "array<struct<key:int,value:bigint>>"
    entries = F.coalesce(F.map_entries(counts), F.array().cast(entry))
    ends = F.concat(entries, F.array(F.struct(F.lit(n).alias("key"), F.lit(None).cast("long").alias("value"))).cast(entry))
    before = F.concat(F.array(F.lit(-1)), F.transform(entries, lambda e: e["key"]))
    zero = F.lit(0).cast("long")
    return F.flatten(F.zip_with(before, ends, lambda p, e: F.concat(
        F.array_repeat(zero, e["key"] - p - 1), F.when(e["value"].isNull(), F.array().cast("array<bigint>")).otherwise(F.array(e["value"])))))


def markers(packets: DataFrame, use_gaps: bool = False) -> DataFrame:
    """(flow, features): length counts as doubles, followed by gap counts when asked for."""
    pl = length_histogram(packets)
    if not use_gaps:
        return pl.select(*FLOW, F.col("pl").cast("array<double>").alias("features"))
    both = pl.join(gap_histogram(packets), FLOW, "left")
    return both.select(*FLOW, F.concat("pl", dense_counts("ipt", gap_bins())).cast("array<double>").alias("features"))


def class_from_path(
    df: DataFrame, benign: tuple[str, ...] = BENIGN_CLASSES, col: str = "pcap_path"
) -> DataFrame:
    """Class = first folder below the root, y_true = 0 for benign names; files in the root drop out."""
    parts = F.split(F.col(col), "/")
    return df.filter(F.size(parts) >= 2).withColumn("class_name", parts[0]).withColumn(
        "y_true", F.when(F.col("class_name").isin(*benign), 0).otherwise(1))


def flow_dataset(packets: DataFrame, use_gaps: bool = False) -> DataFrame:
    """Labelled markers: flow key, features, class_name, y_true."""
    ready = with_flow_key(usable_packets(packets))
    return class_from_path(markers(ready, use_gaps))


def first_lengths(packets: DataFrame, n: int = MAX_PACKETS, order: str = "event_id") -> DataFrame:
    """(pcap_path, lengths): the first ``n`` packet lengths of each capture in time order.

    The rank limit is applied on the map side before anything is gathered, so a capture never
    collects more than ``n`` entries.
    """
    w = Window.partitionBy("pcap_path").orderBy("ts", order)
    first = packets.select(
        "pcap_path", F.coalesce("ip_len", "frame_len").alias("len"),
        F.row_number().over(w).alias("pos")).filter(F.col("pos") <= n)
    seq = first.groupBy("pcap_path").agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("s"))
    return seq.select("pcap_path", F.col("s.len").alias("lengths"))
