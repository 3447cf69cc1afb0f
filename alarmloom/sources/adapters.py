"""Alarm, packet, raw-flow, prediction and score tables seen through the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Seconds since 1970 of a timestamp without time zone, whatever the session time zone is.
_AGE = "(ts - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
EPOCH_SECONDS = (
    f"((extract(DAY FROM {_AGE}) * 86400L + extract(HOUR FROM {_AGE}) * 3600L"
    f" + extract(MINUTE FROM {_AGE}) * 60L) * 1000000L"
    f" + cast(extract(SECOND FROM {_AGE}) * 1000000 AS bigint)) / 1e6D"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, features, y_true, y_pred and a ready partition given_cid."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("long").alias("index"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when((F.col("label") < 5) == (F.col("vec_id") % 4 == 0), 1).otherwise(0).alias("y_true"),
        F.lit(1).alias("y_pred"),
        F.col("label").cast("long").alias("given_cid"),
    )


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and numeric flow columns with bad values, a label and an origin file."""
    li = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        F.col("l_linestatus").alias("origin_file"),
        F.col("l_returnflag").alias("Label"),
        F.when((F.col("l_linenumber") == 1) & (quantity == 1), "Infinity")
        .when((F.col("l_linenumber") == 2) & (quantity == 2), "bad")
        .otherwise(quantity.cast("string")).alias("c0"),
        F.col("l_extendedprice").cast("double").alias("c1"),
        F.col("l_discount").cast("double").alias("c2"),
        F.col("l_tax").cast("double").alias("c3"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("row_id"), F.col("event_type").alias("proto")
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packet, both directions of each conversation."""
    ev = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    peer = F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string"))
    port = (F.lit(1024) + F.col("user_id") % 20).cast("int")
    size = F.floor(F.col("value") * 10).cast("int")
    return ev.select(
        F.col("event_id").cast("long").alias("event_id"),
        F.when(F.col("event_type") == "error", "attack/a.pcap")
        .otherwise("benign/b.pcap").alias("pcap_path"),
        F.expr(EPOCH_SECONDS).alias("ts"),
        F.when(even, peer).otherwise("10.0.1.1").alias("src_ip"),
        F.when(even, F.lit("10.0.1.1")).otherwise(peer).alias("dst_ip"),
        F.when(even, port).otherwise(443).alias("sport"),
        F.when(even, 443).otherwise(port).alias("dport"),
        F.when(F.col("event_type") == "signup", 17)
        .when(F.col("event_type") == "view", 1).otherwise(6).alias("proto"),
        F.when(F.col("event_id") % 10 != 0, size).alias("ip_len"),
        (size + 14).alias("frame_len"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("long").alias("id"),
        F.col("quality").cast("int").alias("y_true"),
        F.col("toxic").cast("int").alias("y_pred"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("id"),
        F.col("value").cast("double").alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"),
    )
