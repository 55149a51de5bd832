"""Row shapes of streams, and canonical ticks from open payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.config import Config

#: A stream's total order: event time, sequence in it, place among rows that share both.
ORDER = ("ts", "seq", "pos")

TICK = "symbol string, seq long, ts timestamp_ntz, price double, volume double, bid double, ask double, ts_ns long"
EVENT = "symbol string, seq long, ts timestamp_ntz, type string, payload string"
BOOK_EVENT = "symbol string, seq long, ts timestamp_ntz, kind string, feed_id int, epoch int, order_id long, side string, price double, size long, priority long, aggressor string, tick_size double"
VALUE = "symbol string, ts timestamp_ntz, seq long, pos int, value double"
LEVEL = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("price", "size", "orders", "notional")]))


def number(parsed: Column, member: str) -> Column:
    """A member of a parsed JSON object (a variant) as a double if it is a number, else null; strings aren't parsed as numbers."""
    path = "$['" + member.replace("'", "\\'") + "']"
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(parsed, path, "double"))


def aliases(parsed: Column, names: tuple[str, ...]) -> Column:
    """The first of the members, in the order of names, that is a number."""
    return F.coalesce(*(number(parsed, n) for n in names)) if names else F.lit(None).cast("double")


def canonical_ticks(events: DataFrame, config: Config = Config()) -> DataFrame:
    """TICK rows of EVENT rows: without a price no tick, without a volume 0; bid and ask only if mapped and above 0."""
    positive = lambda c: F.when(c > 0, c)
    parsed = F.col("__parsed")
    return events.select("symbol", "seq", "ts", F.try_parse_json("payload").alias("__parsed")).select(
        "symbol",
        "seq",
        "ts",
        aliases(parsed, config.price_fields).alias("price"),
        F.coalesce(aliases(parsed, config.volume_fields), F.lit(0.0)).alias("volume"),
        positive(aliases(parsed, config.bid_fields)).alias("bid"),
        positive(aliases(parsed, config.ask_fields)).alias("ask"),
        number(parsed, config.timestamp_field).cast("long").alias("ts_ns") if config.timestamp_field else F.lit(None).cast("long").alias("ts_ns"),
    ).where("price is not null")


def with_quotes(ticks: DataFrame) -> DataFrame:
    """Adds spread where both sides of the quote are there."""
    return ticks.withColumn("spread", F.col("ask") - F.col("bid"))


def coerce(kind: T.DataType, value: Column) -> Column:
    """A stream value as the double that functions see: booleans 1 and 0, numbers themselves, all else 0."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value.cast("int").cast("double"), F.lit(0.0))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value.cast("double"), F.lit(0.0))
    return F.when(value.isNull(), F.lit(0.0)).otherwise(F.lit(0.0))


def first_symbols(df: DataFrame, cap: int) -> DataFrame:
    """df with the first cap symbols to be seen; 0 leaves all. The ranking is over one row per symbol."""
    if cap <= 0:
        return df
    from pyspark.sql import Window

    seen = df.groupBy("symbol").agg(F.min(F.struct("ts", "seq")).alias("seen"))
    kept = seen.withColumn("rank", F.row_number().over(Window.orderBy("seen", "symbol"))).where(F.col("rank") <= cap).select("symbol")
    return df.join(kept, "symbol", "left_semi")
