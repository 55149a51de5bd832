"""Blocks of a symbol's sequence, so that a hot symbol's running functions spread over tasks.

A running function looks back on a bounded number of rows. So a symbol's rows can be cut into blocks of consecutive
rows, each with a halo: the rows before it that its frames reach. A block with its halo is a partition of its own, and
what is computed on halo rows is thrown away. Blocks are made of time buckets, whose counts are a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_blocks(df: DataFrame, reach: int, target: int, bucket_seconds: int, key: str = "symbol") -> DataFrame:
    """df with columns block and halo; rows that a later block's frames of up to `reach` rows need are repeated as its halo.

    A block has about `target` rows, at least four times the reach; a row belongs to one block and to the halo of two at most.
    """
    target = max(target, 4 * reach)
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    rows = df.withColumn("bucket", bucket)
    counts = rows.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_key = Window.partitionBy(key).orderBy("bucket")
    before = F.coalesce(F.sum("n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("start", before).withColumn("end", F.col("start") + F.col("n")).withColumn("block", F.floor(F.col("start") / F.lit(target)))
    starts = placed.groupBy(key, "block").agg(F.min("start").alias("block_start"))
    by_block = Window.partitionBy(key).orderBy("block")
    following = F.array(*(F.struct(F.lead("block", k).over(by_block).alias("block"), F.lead("block_start", k).over(by_block).alias("start")) for k in (1, 2)))
    starts = starts.select(key, "block", following.alias("following"))
    near = F.filter("following", lambda x: x["block"].isNotNull() & (F.col("end") > x["start"] - F.lit(reach - 1)))
    homes = placed.join(starts, [key, "block"]).select(key, "bucket", F.concat(F.array(F.struct("block", F.lit(False).alias("halo"))), F.transform(near, lambda x: F.struct(x["block"].alias("block"), F.lit(True).alias("halo")))).alias("homes"))
    return rows.join(homes, [key, "bucket"]).select(*[rows[c] for c in df.columns], F.inline("homes"))


def over_blocks(df: DataFrame, reach: int, run: Callable[[DataFrame, tuple[str, ...]], DataFrame], target: int = 200_000, bucket_seconds: int = 3600, key: str = "symbol") -> DataFrame:
    """run(df with block and halo, partition keys) on blocks; run must keep those columns. Halo rows are dropped from its result.

    What counts rows since a symbol's first one sees at most `reach` of them on a later block, so it must be capped at that.
    """
    out = run(with_blocks(df, reach, target, bucket_seconds, key), (key, "block"))
    return out.where("not halo").drop("block", "halo")


def numbered(df: DataFrame, order: tuple[str, ...] = ("ts", "seq", "pos"), bucket_seconds: int = 3600, key: str = "symbol", name: str = "n") -> DataFrame:
    """df with each row's number in its key's order, from 1: counted within time buckets, each of which is a partition, from what the buckets before hold."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(key).alias("__key"), F.col("__bucket").alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)))
    both = own.join(bases, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__of")))
    return both.select(*df.columns, (F.col(name) + F.col("__before")).alias(name))
