"""Latest-value lookup: for each row the last known value at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 3_600


def asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = (), inclusive: bool = True, bucket_seconds: int = BUCKET_SECONDS, keep_unmatched: bool = False, by_time: bool = False) -> DataFrame:
    """left's rows with `found`, the last value of right (keys, ts, seq, value) at or before (or, if not inclusive, before) their (ts, seq).

    Both sides are dealt by key and time bucket; what a bucket must know of earlier ones is one row per bucket, so neither
    a single key nor a long history meets in one task. Nulls among right's values are no values. Rows without a value are
    dropped unless keep_unmatched: nothing is emitted for them. by_time compares times alone: all values of a row's own time
    are known (or, if not inclusive, unknown) to it, whatever their seq, and the last of them in seq is found.
    """
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    names = left.columns
    kind = right.schema["value"].dataType
    a = left.select(F.struct(*names).alias("row"), *keys, "ts", "seq", F.lit(1 if inclusive else 0).alias("side"), F.lit(None).cast(kind).alias("known"), bucket.alias("bucket"))
    b = right.where("value is not null").select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *keys, "ts", "seq", F.lit(0 if inclusive else 1).alias("side"), F.col("value").alias("known"), bucket.alias("bucket"))
    last = b.groupBy(*keys, "bucket").agg(F.max_by("known", F.struct("ts", "seq")).alias("carry"))
    spans = a.select(*keys, "bucket").distinct().join(last, [*keys, "bucket"], "full")
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "bucket", F.last("carry", True).over(before).alias("carry"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(*(("ts", "side", "seq") if by_time else ("ts", "seq", "side"))).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("own", F.last("known", True).over(inside)).where("row is not null")
    out = both.join(spans, [*keys, "bucket"], "left").select("row.*", F.coalesce("own", "carry").alias("found"))
    return out if keep_unmatched else out.where("found is not null")
