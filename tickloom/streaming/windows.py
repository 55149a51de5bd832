"""Tumbling windows of streams: event time, a watermark that bounds state, append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import GroupBasis
from tickloom.functions.builtin import Reducer
from tickloom.operators.nodes import check_period


def tumble_reduce(stream: DataFrame, period_ms: int, reducers: dict[str, Reducer], delay: str = "0 seconds") -> DataFrame:
    """(symbol, ts, a column per reducer) of each closed bucket; rows later than the delay are dropped, which bounds the state."""
    check_period(period_ms)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("pos", F.lit(0))
    basis = GroupBasis(F.col("value"))
    grouped = rows.groupBy("symbol", F.window("ts", f"{period_ms} milliseconds").alias("w")).agg(*(f(basis).alias(f"r{k}") for k, f in enumerate(reducers.values())))
    return grouped.select("symbol", F.col("w.end").alias("ts"), *(F.col(f"r{k}").alias(name) for k, name in enumerate(reducers)))


def sliding_reduce(stream: DataFrame, length: str, slide: str, reducers: dict[str, Reducer], delay: str = "0 seconds") -> DataFrame:
    """As tumble_reduce() over overlapping windows, an extension."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("pos", F.lit(0))
    basis = GroupBasis(F.col("value"))
    grouped = rows.groupBy("symbol", F.window("ts", length, slide).alias("w")).agg(*(f(basis).alias(f"r{k}") for k, f in enumerate(reducers.values())))
    return grouped.select("symbol", F.col("w.end").alias("ts"), *(F.col(f"r{k}").alias(name) for k, name in enumerate(reducers)))


def sessions(stream: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """(symbol, start, end, n, total) of runs of values without a gap, an extension."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    grouped = rows.groupBy("symbol", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select("symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")
