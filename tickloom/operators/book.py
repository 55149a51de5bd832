"""Order books as grouped aggregates: live orders, price levels, ladders, top of book, gaps, deltas.

Book events are rows of schema.BOOK_EVENT. Prices are whole ticks inside, so levels are never matched on doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What names an order.
ORDER_KEY = ("symbol", "feed_id", "epoch", "order_id")
GRID = 1e-8


def ticks_of(price: Column, tick_size: Column | float) -> Column:
    """Whole ticks, halves away from zero, with a nudge for what division loses."""
    scaled = price / (tick_size if isinstance(tick_size, Column) else F.lit(float(tick_size)))
    finite = ~F.isnan(scaled) & (F.abs(scaled) < 9e18)
    return F.round(F.when(finite, scaled + F.signum(scaled) * 1e-12)).cast("long")


def valid_price(price: Column, tick_size: Column | float, negative: bool = False) -> Column:
    """Finite, not 0, on the grid of ticks, and positive unless negative prices are allowed."""
    scaled = price / (tick_size if isinstance(tick_size, Column) else F.lit(float(tick_size)))
    finite = price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf"))
    return finite & (price != 0) & (F.lit(negative) | (price > 0)) & (F.abs(scaled - F.round(scaled)) <= GRID * F.greatest(F.lit(1.0), F.abs(scaled)))


def quantised(events: DataFrame, tick_size: float = 1e-4, negative: bool = False) -> DataFrame:
    """events that the book takes, with price_ticks: bad prices and sizes are dropped where the kind needs them."""
    price_ok, size_ok = valid_price(F.col("price"), tick_size, negative), F.col("size") > 0
    good = F.when(F.col("kind") == "add", price_ok & size_ok).when(F.col("kind") == "update", (F.col("price").isNull() | price_ok) & (F.col("size").isNull() | size_ok) & (F.col("price").isNotNull() | F.col("size").isNotNull())).when(F.col("kind") == "trade", price_ok & size_ok).otherwise(True)
    return events.where(good).withColumn("price_ticks", ticks_of(F.col("price"), tick_size))


def live_orders(events: DataFrame, keys: tuple[str, ...] = ORDER_KEY) -> DataFrame:
    """Orders on the book after all events, with their last price and size, one grouped aggregate.

    An add of a known order replaces it; a delete ends it; updates change what they carry. queued is the sequence number
    that gives the order its place in the queue: its add, or its last change of price or priority.
    """
    kind, seq = F.col("kind"), F.col("seq")
    added, gone = F.max(F.when(kind == "add", seq)), F.max(F.when(kind == "delete", seq))
    change = kind.isin("add", "update")
    last = lambda c: F.max_by(c, F.when(change & F.col(c).isNotNull(), seq))
    moved = F.max(F.when((kind == "add") | ((kind == "update") & F.col("price").isNotNull()) | (kind == "priority"), seq))
    out = events.where(kind.isin("add", "update", "delete", "priority")).groupBy(*keys).agg(added.alias("added"), gone.alias("gone"), F.max_by("side", F.when(kind == "add", seq)).alias("side"), last("price_ticks").alias("price_ticks"), last("price").alias("price"), last("size").alias("size"), moved.alias("queued"))
    return out.where("added is not null and (gone is null or gone < added)").drop("added", "gone")


def levels(orders: DataFrame) -> DataFrame:
    """(symbol, side, price_ticks, price, size, orders, notional) of each price with live orders."""
    out = orders.where("size > 0").groupBy("symbol", "side", "price_ticks").agg(F.min("price").alias("price"), F.sum("size").cast("double").alias("size"), F.count(F.lit(1)).cast("double").alias("orders"))
    return out.withColumn("notional", F.col("price") * F.col("size"))


def level_updates(events: DataFrame) -> DataFrame:
    """Aggregated books: the last summary of each (symbol, side, price); size 0 removes the level.

    If events have a kind, those of kind snapshot_level that share a seq replace the book: only what comes from the last of them on counts.
    """
    if "kind" in events.columns:
        last = events.where("kind = 'snapshot_level'").groupBy("symbol").agg(F.max("seq").alias("from_seq"))
        events = events.join(last, "symbol", "left").where("from_seq is null or seq >= from_seq").drop("from_seq")
    last = events.groupBy("symbol", "side", "price_ticks").agg(F.max_by("size", "seq").alias("size"), F.max_by("price", "seq").alias("price"))
    return last.where("size > 0").select("symbol", "side", "price_ticks", "price", F.col("size").cast("double").alias("size"), F.lit(None).cast("double").alias("orders"), (F.col("price") * F.col("size")).alias("notional"))


def since_snapshot(events: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Events from each symbol's last snapshot on; a snapshot is events of kind snapshot that share a sequence number and stand for adds."""
    last = events.where("kind = 'snapshot'").groupBy(*keys).agg(F.max("seq").alias("from_seq"))
    kept = events.join(last, list(keys), "left").where("from_seq is null or seq >= from_seq").drop("from_seq")
    return kept.withColumn("kind", F.when(F.col("kind") == "snapshot", "add").otherwise(F.col("kind")))


def ladder(book_levels: DataFrame, depth: int | None = None) -> DataFrame:
    """Levels with lvl, 1 for the best of each side; a side's levels are few, whatever its orders."""
    order = F.when(F.col("side") == "bid", -F.col("price_ticks")).otherwise(F.col("price_ticks"))
    out = book_levels.withColumn("lvl", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(order)))
    return out if depth is None else out.where(F.col("lvl") <= depth)


def snapshot(ladder_rows: DataFrame) -> DataFrame:
    """One row per symbol: bids and asks as arrays of (price, size, orders, notional), best first."""
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("lvl", "price", "size", "orders", "notional")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"), x["orders"].alias("orders"), x["notional"].alias("notional")))
    return ladder_rows.groupBy("symbol").agg(side("bid").alias("bids"), side("ask").alias("asks"))


def top(book_levels: DataFrame) -> DataFrame:
    """Best bid and ask with their sizes, without ranking: one aggregate."""
    bid, ask, at = F.col("side") == "bid", F.col("side") == "ask", F.col("price_ticks")
    return book_levels.groupBy("symbol").agg(
        F.max_by("price", F.when(bid, at)).alias("bid"),
        F.max_by("size", F.when(bid, at)).alias("bid_size"),
        F.min_by("price", F.when(ask, at)).alias("ask"),
        F.min_by("size", F.when(ask, at)).alias("ask_size"),
    )


def passive_side(aggressor: Column, price: Column, bid: Column, ask: Column) -> Column:
    """The side that a trade consumes: against the aggressor, or else by the quote; inside the spread none."""
    return F.when(aggressor == "buy", "ask").when(aggressor == "sell", "bid").when(price <= bid, "bid").when(price >= ask, "ask")


def trade_fifo(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """orders with consumed and left after trades (symbol, side, price_ticks, traded): each level's queue pays in order, the excess is ignored.

    Trades at a level are summed first, so any number of them is one row per level.
    """
    paid = trades.groupBy("symbol", "side", "price_ticks").agg(F.sum("traded").alias("traded"))
    queue = Window.partitionBy("symbol", "side", "price_ticks").orderBy("queued", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.sum("size").over(queue) - F.col("size")
    consumed = F.least(F.col("size"), F.greatest(F.lit(0), F.coalesce(F.col("traded"), F.lit(0)) - F.col("ahead")))
    out = orders.withColumn("ahead", ahead).join(paid, ["symbol", "side", "price_ticks"], "left").withColumn("consumed", consumed)
    return out.withColumn("left", F.col("size") - F.col("consumed")).drop("ahead", "traded")


def sequencing(events: DataFrame) -> DataFrame:
    """events with gap and stale: a number that doesn't follow the last one is a gap, from which on all is stale until a snapshot; a reset is stale too.

    Events are (symbol, arrived, seq, kind); arrived is their order of arrival. A first event is never a gap.
    """
    order = Window.partitionBy("symbol").orderBy("arrived")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("kind").isin("snapshot")
    epoch = F.sum(F.when(F.col("kind") == "reset", 1).otherwise(0)).over(upto)
    base = events.withColumn("epoch_no", epoch).withColumn("island", F.sum(F.when(fresh, 1).otherwise(0)).over(upto))
    before = F.lag("seq").over(Window.partitionBy("symbol", "island").orderBy("arrived"))
    gap = (F.col("kind") != "reset") & ~fresh & before.isNotNull() & (F.col("seq") != before + 1)
    own = Window.partitionBy("symbol", "island").orderBy("arrived").rowsBetween(Window.unboundedPreceding, 0)
    marked = base.withColumn("gap", gap)
    return marked.withColumn("stale", F.max(F.when(F.col("gap") | (F.col("kind") == "reset"), 1).otherwise(0)).over(own) == 1).drop("island")


def deltas(changes: DataFrame) -> DataFrame:
    """Of signed size changes (symbol, seq, side, price_ticks, delta) each level's total after them, its before, and a number per symbol from 1."""
    level = Window.partitionBy("symbol", "side", "price_ticks").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = changes.withColumn("total", F.sum("delta").over(level)).withColumn("before", F.col("total") - F.col("delta"))
    return out.withColumn("number", F.row_number().over(Window.partitionBy("symbol").orderBy("seq", "side", "price_ticks")))


def resolve_venue_keys(events: DataFrame, names: DataFrame) -> DataFrame:
    """events with the order_id that their venue_key stood for at their time; names are (symbol, venue_key, ts, seq, order_id), the latest counts.

    An event that has an order_id keeps it; one whose key was never named has none.
    """
    from tickloom.operators.asof import asof

    found = asof(events, names.select("symbol", "venue_key", "ts", "seq", F.col("order_id").alias("value")), ("symbol", "venue_key"), keep_unmatched=True)
    return found.withColumn("order_id", F.coalesce("order_id", "found")).drop("found")


def faults(orders: DataFrame, book_levels: DataFrame) -> DataFrame:
    """Levels whose total isn't the sum of their orders, or isn't positive; empty if the book is sound."""
    own = orders.groupBy("symbol", "side", "price_ticks").agg(F.sum("size").alias("own"))
    both = own.join(book_levels.select("symbol", "side", "price_ticks", "size"), ["symbol", "side", "price_ticks"], "full")
    return both.where("own is null or size is null or own <> size or size <= 0")


def meta(events: DataFrame) -> DataFrame:
    """(symbol, seq, epoch, is_stale, last_change_ms) after all events: stale if a reset came after the last snapshot."""
    last = lambda kind: F.coalesce(F.max(F.when(F.col("kind").startswith(kind), F.col("seq"))), F.lit(-1))
    return events.groupBy("symbol").agg(F.max("seq").alias("seq"), F.max("epoch").alias("epoch"), (last("reset") > last("snapshot")).cast("int").alias("is_stale"), F.unix_millis(F.max("ts").cast("timestamp")).alias("last_change_ms"))


def stats(events: DataFrame) -> DataFrame:
    """Counts of events by symbol and kind."""
    return events.groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"))
