"""Tick streams of Parquet event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_ticks(spark: SparkSession, path: str, symbol: str = "event_type") -> DataFrame:
    """Ticks of an events table: symbol, seq, ts, price (value), volume (k of props) and drift, the price about its usual level."""
    events = spark.read.parquet(path)
    volume = F.get_json_object("props", "$.k").cast("double")
    return events.select(F.col(symbol).cast("string").alias("symbol"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), volume.alias("volume"), (F.col("value") * 0.01 - 0.5).alias("drift"))


def order_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of an orders table: one symbol per priority, the total as the price."""
    orders = spark.read.parquet(path)
    return orders.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))
