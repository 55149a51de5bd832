"""Newline-delimited JSON feeds: hygiene, routing by type, and book messages as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINE, MAX_SYMBOL = 65_536, 64
#: Members of book messages; a string is no number.
MESSAGE = "action string, side string, aggressor string, id long, price double, size double, priority double, tickSize double, epoch double"
#: Members that each book action must have, and numbers among them.
REQUIRED = {"ticksize": ("tickSize",), "add": ("id", "price", "size"), "update": ("id",), "delete": ("id",), "trade": ("price", "size")}


def _member(line: Column, name: str) -> Column:
    return F.get_json_object(line, f"$.{name}")


def classify(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with symbol, type (tick, ob or control) and reject: why a line isn't taken, or null."""
    line = F.col(line_col)
    parsed = F.try_parse_json(line)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    symbol = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.symbol", "variant")) == "STRING", _member(line, "symbol"))
    reject = (
        F.when(line.isNull() | (F.trim(line) == ""), "empty")
        .when(F.octet_length(line) > MAX_LINE, "too long")
        .when(parsed.isNull() | ~F.coalesce(is_object, F.lit(False)), "not an object")
        .when(symbol.isNull() | (symbol == ""), "no symbol")
        .when(F.length(symbol) > MAX_SYMBOL, "symbol too long")
    )
    kind = _member(line, "type")
    return lines.select("*", symbol.alias("symbol"), F.when(kind.isin("ob", "control"), kind).otherwise("tick").alias("type"), reject.alias("reject"))


def ticks(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """EVENT rows of the lines that are ticks; lines need seq and ts."""
    good = classify(lines, line_col).where("reject is null and type = 'tick'")
    return good.select("symbol", "seq", "ts", "type", F.col(line_col).alias("payload"))


def rejects(lines: DataFrame, line_col: str = "line") -> DataFrame:
    return classify(lines, line_col).where("reject is not null")


def book_events(lines: DataFrame, line_col: str = "line", feed_id: int = 0) -> DataFrame:
    """BOOK_EVENT rows of the ob and control lines that are complete; a side that isn't ask is bid."""
    good = classify(lines, line_col).where("reject is null and type in ('ob', 'control')")
    read = good.select("symbol", "seq", "ts", "type", F.from_json(line_col, MESSAGE).alias("m")).select("symbol", "seq", "ts", "type", F.col("m.action").alias("kind"), *(f"m.{n}" for n in ("side", "aggressor", "id", "price", "size", "priority", "tickSize", "epoch")))
    complete = (F.col("type") == "control") & (F.col("kind") == "reset")
    for name, needed in REQUIRED.items():
        has = (F.col("type") == "ob") & (F.col("kind") == name)
        for m in needed:
            has = has & F.col(m).isNotNull()
        complete = complete | (has & (F.col("price").isNotNull() | F.col("size").isNotNull()) if name == "update" else has)
    return read.where(complete).select(
        "symbol", "seq", "ts", "kind", F.lit(feed_id).alias("feed_id"), F.coalesce("epoch", F.lit(0.0)).cast("int").alias("epoch"), F.col("id").alias("order_id"),
        F.when(F.col("kind") == "add", F.when(F.col("side") == "ask", "ask").otherwise("bid")).alias("side"), "price", F.col("size").cast("long").alias("size"), F.col("priority").cast("long").alias("priority"),
        F.when(F.col("aggressor").isin("buy", "sell"), F.col("aggressor")).alias("aggressor"), F.col("tickSize").alias("tick_size"),
    )


def tick_sizes(events: DataFrame, default: float = 1e-4) -> DataFrame:
    """(symbol, tick_size): the last that was told."""
    return events.groupBy("symbol").agg(F.coalesce(F.max_by("tick_size", F.when((F.col("kind") == "ticksize") & (F.col("tick_size") > 0), F.col("seq"))), F.lit(default)).alias("tick_size"))


def by_type(events: DataFrame, kinds: dict[str, object]) -> dict[str, DataFrame]:
    """Each event type's computer on its own events alone."""
    return {kind: computer(events.where(F.col("type") == kind)) for kind, computer in kinds.items()}
