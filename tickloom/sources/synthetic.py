"""Made-up events: a counter per tick, and random walks for trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counters(spark: SparkSession, n: int, tick_ms: int = 1000, symbol: str = "SYNTH", start: str = "2024-01-01") -> DataFrame:
    """n EVENT rows of type synthetic.tick, tick_ms apart, with a payload of their number."""
    at = F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + F.col("id") * tick_ms).cast("timestamp_ntz")
    return spark.range(n).select(F.lit(symbol).alias("symbol"), F.col("id").alias("seq"), at.alias("ts"), F.lit("synthetic.tick").alias("type"), F.to_json(F.struct(F.col("id").cast("double").alias("counter"))).alias("payload"))


def waves(counted: DataFrame, counter: str = "counter") -> DataFrame:
    """Adds the sine and cosine of a tenth of a counter."""
    angle = F.col(counter) * 0.1
    return counted.withColumns({"synthetic_sin": F.sin(angle), "synthetic_cos": F.cos(angle)})


def counter_stream(spark: SparkSession, rows_per_second: int = 1, symbol: str = "SYNTH") -> DataFrame:
    """The same as a stream that never ends."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.lit(symbol).alias("symbol"), F.col("value").alias("seq"), F.col("timestamp").alias("ts"), F.lit("synthetic.tick").alias("type"), F.col("value").cast("double").alias("counter"))


def random_walk(spark: SparkSession, n: int, symbols: tuple[str, ...] = ("AAA", "BBB"), seed: int = 7) -> DataFrame:
    """n ticks per symbol whose prices are sums of normal steps about 100."""
    from pyspark.sql import Window

    steps = spark.range(n).crossJoin(spark.createDataFrame([(s,) for s in symbols], "symbol string")).withColumn("step", F.randn(seed))
    price = 100 + F.sum("step").over(Window.partitionBy("symbol").orderBy("id"))
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 100).cast("timestamp_ntz")
    return steps.select("symbol", F.col("id").alias("seq"), at.alias("ts"), price.alias("price"), (F.col("id") % 100 + 1).cast("double").alias("volume"))
