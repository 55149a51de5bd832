"""ITCH messages as JSON rows to feed events, with windows in place of an adapter's order map.

Messages: seq, ts, type, stock, stock_locate, order_ref, orig_ref, side, shares, price (columns, null where a type has none).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.durable import written

MESSAGE = "seq long, ts timestamp_ntz, type string, stock string, stock_locate int, order_ref long, orig_ref long, side string, shares long, price double"
#: The tick size that a directory message stands for.
TICK_SIZE = 0.01


def parse(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """MESSAGE rows of JSON lines with seq and ts; prices may be strings."""
    get = lambda name: F.get_json_object(line_col, f"$.{name}")
    return lines.select(
        "seq", "ts", get("type").alias("type"), F.trim(get("stock")).alias("stock"), F.try_to_number(get("stockLocate"), F.lit("9999999999")).cast("int").alias("stock_locate"),
        get("orderRef").try_cast("long").alias("order_ref"), get("origOrderRef").try_cast("long").alias("orig_ref"), get("side").alias("side"), get("shares").try_cast("long").alias("shares"), get("price").try_cast("double").alias("price"),
    )


def named(messages: DataFrame) -> DataFrame:
    """messages with the stock that a locate code stands for; the directory is a row per stock."""
    directory = messages.where("type = 'stock_directory' and stock is not null").groupBy("stock_locate").agg(F.trim(F.max_by("stock", "seq")).alias("listed"))
    return messages.join(directory, "stock_locate", "left").withColumn("stock", F.coalesce(F.trim("stock"), "listed")).drop("listed")


#: More shares than any order has.
ALL_SHARES = 1 << 40


def _lives(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of orders (adds) and of the changes to them, with what was resting before and after each; what finds no live order is dropped."""
    stocks = orders.select("ref", F.col("stock").alias("of_stock"), F.col("side").alias("of_side")).dropDuplicates(["ref"])
    later = changes.join(stocks, "ref").withColumns({"stock": F.col("of_stock"), "side": F.col("of_side")}).drop("of_stock", "of_side")
    rows = orders.unionByName(later)
    order = Window.partitionBy("ref").orderBy("seq", "part")
    rows = rows.withColumn("life", F.sum(F.when(F.col("action") == "add", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("life > 0")
    own = Window.partitionBy("ref", "life").orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col("action").isin("executed", "cancel"), F.col("shares")).when(F.col("action").isin("delete", "replace"), F.lit(ALL_SHARES)).otherwise(0)
    rows = rows.withColumns({"mine": mine, "added": F.first("shares").over(own), "resting": F.first("price").over(own)}).withColumn("taken", F.sum("mine").over(own))
    before = F.when(F.col("action") == "add", F.lit(0)).otherwise(F.col("added") - F.col("taken") + F.col("mine"))
    return rows.withColumn("before", before).withColumn("after", F.greatest(F.col("added") - F.col("taken"), F.lit(0))).where("action = 'add' or before > 0").drop("mine", "taken", "life")


def resting(messages: DataFrame) -> DataFrame:
    """Order-related messages with the order they are about: its stock, side, price, and shares left before and after.

    A replacement is two rows: the old order's end, and a new order of its side, which is there only if the old one was. So replacements are
    resolved link by link; each round holds the orders that the round before made, and is written before the next. Messages about
    an order that isn't there, or no longer, are dropped. A reference names one order at a time.
    """
    own = named(messages).where("type in ('add_order', 'add_order_mpid', 'order_executed', 'order_cancel', 'order_delete', 'order_replace')")
    none = F.lit(None)
    side = F.when(F.col("side").startswith("B"), "bid").otherwise("ask")
    columns = lambda ref, part, action, stock, side, price: [F.col(ref).alias("ref"), "seq", F.lit(part).alias("part"), "ts", action.alias("action"), stock.cast("string").alias("stock"), side.cast("string").alias("side"), "shares", price.cast("double").alias("price")]
    orders = own.where("type in ('add_order', 'add_order_mpid')").select(*columns("order_ref", 0, F.lit("add"), F.col("stock"), side, F.col("price")))
    touching = own.where("type in ('order_executed', 'order_cancel', 'order_delete')").select(*columns("order_ref", 0, F.regexp_replace("type", "^order_", ""), none, none, none))
    replaced = own.where("type = 'order_replace'")
    changes = touching.unionByName(replaced.select(*columns("orig_ref", 0, F.lit("replace"), none, none, none)))
    follow = replaced.select(F.col("orig_ref").alias("ref"), "seq", F.col("order_ref").alias("new_ref"), F.col("shares").alias("new_shares"), F.col("price").alias("new_price"))
    rounds = []
    while True:
        found = written(_lives(orders, changes))
        rounds.append(found)
        ended = found.where("action = 'replace'")
        if ended.isEmpty():
            break
        orders = ended.join(follow, ["ref", "seq"]).select(F.col("new_ref").alias("ref"), "seq", F.lit(1).alias("part"), "ts", F.lit("add").alias("action"), "stock", "side", F.col("new_shares").alias("shares"), F.col("new_price").alias("price"))
    return reduce(DataFrame.unionByName, rounds)


def events(messages: DataFrame) -> DataFrame:
    """(symbol, seq, part, ts, kind, order_id, side, price, size, aggressor): what each message does to book and ticks.

    An execution updates or deletes the order, and is a trade at its price against its side and a tick.
    """
    rows = resting(messages).withColumnRenamed("stock", "symbol")
    nothing = F.lit(None).cast("string")
    kind = F.when(F.col("action") == "add", "add").when(F.col("after") > 0, "update").otherwise("delete")
    body = F.struct(F.lit(0).alias("step"), kind.alias("kind"), "side", F.when(F.col("action") == "add", F.col("price")).alias("price"), F.when(F.col("action") == "add", F.col("shares")).when(F.col("after") > 0, F.col("after")).alias("size"), nothing.alias("aggressor"))
    size = F.least("shares", "before")
    trade = F.struct(F.lit(1).alias("step"), F.lit("trade").alias("kind"), "side", F.col("resting").alias("price"), size.alias("size"), F.when(F.col("side") == "bid", "sell").otherwise("buy").alias("aggressor"))
    tick = F.struct(F.lit(2).alias("step"), F.lit("tick").alias("kind"), nothing.alias("side"), F.col("resting").alias("price"), size.alias("size"), nothing.alias("aggressor"))
    each = F.when(F.col("action") == "executed", F.array(body, trade, tick)).otherwise(F.array(body))
    of_orders = rows.select("symbol", "seq", "part", "ts", F.col("ref").alias("order_id"), F.explode(each).alias("e")).select("symbol", "seq", (F.col("part") * 3 + F.col("e.step")).alias("part"), "ts", "e.kind", "order_id", "e.side", "e.price", "e.size", "e.aggressor")
    prints = named(messages).where("type = 'trade' and stock is not null and price is not null and shares is not null")
    aggressor = F.when(F.col("side").startswith("B"), "buy").when(F.col("side").startswith("S"), "sell")
    both = prints.select(F.col("stock").alias("symbol"), "seq", "ts", "price", F.col("shares").alias("size"), F.explode(F.array(F.struct(F.lit(1).alias("step"), F.lit("trade").alias("kind"), aggressor.alias("aggressor")), F.struct(F.lit(2).alias("step"), F.lit("tick").alias("kind"), nothing.alias("aggressor")))).alias("e"))
    of_prints = both.select("symbol", "seq", F.col("e.step").alias("part"), "ts", "e.kind", F.lit(None).cast("long").alias("order_id"), nothing.alias("side"), "price", "size", "e.aggressor")
    listed = messages.where("type = 'stock_directory' and stock is not null").select(F.trim("stock").alias("symbol"), "seq", F.lit(0).alias("part"), "ts", F.lit("ticksize").alias("kind"), F.lit(None).cast("long").alias("order_id"), nothing.alias("side"), F.lit(TICK_SIZE).alias("price"), F.lit(None).cast("long").alias("size"), nothing.alias("aggressor"))
    return of_orders.unionByName(of_prints).unionByName(listed)
