"""Streams from files and sockets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder; so many per micro-batch bound what one takes on."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(line, ts, seq) of new text files of newline-delimited JSON."""
    lines = spark.readStream.text(folder)
    return lines.select(F.col("value").alias("line"), F.current_timestamp().alias("ts"), F.monotonically_increasing_id().alias("seq"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """(line, ts) of a TCP feed, for trials."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load().select(F.col("value").alias("line"), F.col("timestamp").alias("ts"))
