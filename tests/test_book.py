import random

import pytest
from helpers import T0, mean, same
from pyspark.sql import functions as F

from tickloom.operators import book, obkeys, replay
from tickloom.schema import BOOK_EVENT


def events(spark, rows):
    """rows: dicts of a book event, in order."""
    base = dict.fromkeys(("side", "price", "size", "priority", "aggressor", "tick_size", "order_id"))
    full = [base | {"symbol": "A", "feed_id": 0, "epoch": 0, "ts": T0, "seq": i + 1} | r for i, r in enumerate(rows)]
    names = [c.split()[0] for c in BOOK_EVENT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], BOOK_EVENT)


def test_quantise(spark):
    df = spark.createDataFrame([(1.23,), (1.2345,), (0.0,), (-1.0,), (float("nan"),), (None,)], "p double")
    got = df.select(book.ticks_of(F.col("p"), 0.01).alias("t"), book.valid_price(F.col("p"), 0.01).alias("ok")).collect()
    assert got[0]["t"] == 123 and [r["ok"] for r in got][:4] == [True, False, False, False] and not got[4]["ok"] and not got[5]["ok"]


def test_live_orders(spark):
    rows = [
        {"kind": "add", "order_id": 1, "side": "bid", "price": 10.0, "size": 5}, {"kind": "add", "order_id": 2, "side": "bid", "price": 10.0, "size": 7}, {"kind": "update", "order_id": 1, "size": 3},
        {"kind": "add", "order_id": 3, "side": "ask", "price": 11.0, "size": 4}, {"kind": "delete", "order_id": 3}, {"kind": "update", "order_id": 3, "size": 9}, {"kind": "update", "order_id": 9, "size": 9},
        {"kind": "add", "order_id": 4, "side": "ask", "price": 12.0, "size": 4}, {"kind": "update", "order_id": 4, "price": 13.0}, {"kind": "delete", "order_id": 2}, {"kind": "add", "order_id": 2, "side": "bid", "price": 9.0, "size": 1},
        {"kind": "update", "order_id": 1, "size": 0}, {"kind": "add", "order_id": 5, "side": "bid", "price": 10.0, "size": -1},
    ]
    got = {r["order_id"]: (r["side"], r["price"], r["size"], r["queued"]) for r in book.live_orders(book.quantised(events(spark, rows))).collect()}
    assert got == {1: ("bid", 10.0, 3, 1), 2: ("bid", 9.0, 1, 11), 4: ("ask", 13.0, 4, 9)}


def test_replay_equals_aggregate(spark):
    pick = random.Random(4)
    rows = []
    for _ in range(400):
        kind = pick.choice(["add", "add", "update", "delete"])
        r = {"kind": kind, "symbol": pick.choice("AB"), "order_id": pick.randrange(1, 40)}
        if kind == "add":
            r |= {"side": pick.choice(["bid", "ask"]), "price": float(pick.randrange(90, 110)), "size": pick.randrange(1, 9)}
        elif kind == "update":
            r |= {"size": pick.randrange(1, 9)} if pick.random() < 0.6 else {"price": float(pick.randrange(90, 110))}
        rows.append(r)
    own = book.quantised(events(spark, rows), tick_size=1.0)
    levels = {(r["symbol"], r["side"], r["price_ticks"]): int(r["size"]) for r in book.levels(book.live_orders(own)).collect()}
    changes = replay.replay(own)
    last = changes.groupBy("symbol", "side", "price_ticks").agg(F.max_by("total", "number").alias("total")).where("total > 0").collect()
    assert {(r["symbol"], r["side"], r["price_ticks"]): r["total"] for r in last} == levels
    assert book.faults(book.live_orders(own), book.levels(book.live_orders(own))).count() == 0
    numbers = [r["number"] for r in changes.where("symbol = 'A'").select("number").distinct().orderBy("number").collect()]
    assert numbers == list(range(1, len(numbers) + 1))


def test_trades_take_the_queue_in_order():
    b = replay.Book()
    b.add((0, 0, 1), "ask", 100, 50)
    assert b.trade(100, 30, "buy") and b.total("ask", 100) == 20
    assert b.trade(100, 20, "buy") and b.best("ask") is None
    for k, size in ((1, 50), (2, 20), (3, 40)):
        b.add((0, 0, k), "bid", 99, size)
    b.update((0, 0, 1), None, 45)  # keeps its place
    b.prioritise((0, 0, 2))  # loses it
    assert b.trade(99, 60, None) and list(b.queues["bid"][99].values()) == [25, 20]
    assert not b.trade(98, 5, "sell") and not b.trade(150, 5, "buy")
    b.add((0, 0, 9), "ask", 103, 1)
    assert not b.trade(101, 5, None)


def test_staleness():
    b = replay.Book()
    assert [b.on_seq(x) for x in (1, 2, 5, 6)] == [True, True, False, False]
    b.snapshot([((0, 0, 1), "bid", 10, 3)], 7)
    assert not b.stale and b.on_seq(8) and b.total("bid", 10) == 3
    b.reset(2)
    b.apply({"kind": "add", "order_id": 5, "side": "bid", "price_ticks": 9, "size": 1})
    assert b.stale and b.total("bid", 9) == 0
    first = b.add(None, "ask", 20, 2)
    assert first[-1] == -1 and b.delete(first) and not b.delete(first)
    b.summary("ask", 21, 5)
    b.summary("ask", 21, 0)
    assert b.best("ask") is None


def test_fifo_by_sums(spark):
    orders = spark.createDataFrame([("A", "ask", 5, i, i, s) for i, s in enumerate([50, 20, 40])], "symbol string, side string, price_ticks long, order_id long, queued long, size long")
    trades = spark.createDataFrame([("A", "ask", 5, 60)], "symbol string, side string, price_ticks long, traded long")
    assert [r["left"] for r in book.trade_fifo(orders, trades).orderBy("order_id").collect()] == [0, 10, 40]


def test_passive_side(spark):
    df = spark.createDataFrame([("buy", 1.0), ("sell", 1.0), (None, 9.0), (None, 12.0), (None, 10.5)], "a string, p double")
    got = [r[0] for r in df.select(book.passive_side(F.col("a"), F.col("p"), F.lit(10.0), F.lit(11.0))).collect()]
    assert got == ["ask", "bid", "bid", "ask", None]


def test_snapshots_replace(spark):
    rows = [{"kind": "add", "order_id": 1, "side": "bid", "price": 1.0, "size": 1}, {"kind": "snapshot", "order_id": 2, "side": "bid", "price": 2.0, "size": 2, "seq": 5}, {"kind": "snapshot", "order_id": 3, "side": "ask", "price": 3.0, "size": 2, "seq": 5}, {"kind": "delete", "order_id": 3, "seq": 6}]
    got = book.live_orders(book.quantised(book.since_snapshot(events(spark, rows)))).collect()
    assert [r["order_id"] for r in got] == [2]


LEVELS = [("bid", 57, 4, 2), ("bid", 55, 9, 1), ("bid", 52, 3, 3), ("bid", 41, 12, 4), ("ask", 60, 8, 2), ("ask", 61, 5, 5), ("ask", 66, 21, 7)]


@pytest.fixture(scope="module")
def ladder(spark):
    levels = spark.createDataFrame([("A", s, p * 10_000, float(p), float(z), float(o), float(p * z)) for s, p, z, o in LEVELS], "symbol string, side string, price_ticks long, price double, size double, orders double, notional double")
    return book.ladder(levels)


def by_hand(key, levels):
    """A key's value from the levels (side, price, size, orders), by loops over them."""
    parts = key.split(".")[1:]
    mode = parts.pop() if parts[-1] == "agg" else "per"
    side = lambda s: sorted((x for x in levels if x[0] == s), key=lambda x: -x[1] if s == "bid" else x[1])
    number = lambda t: float(t.replace("p", "."))
    attribute = lambda x, name: None if name == "orders" and mode == "agg" else {"price": x[1], "size": x[2], "orders": x[3], "notional": x[1] * x[2]}[name]

    def chosen(s, by, span):
        low, _, high = span.partition("-")
        low, high = (number(low), number(high)) if high else (1, number(low))
        return [x for k, x in enumerate(side(s), 1) if low <= (k if by == "levels" else x[1]) <= high]

    match parts:
        case ["spread"]:
            return side("ask")[0][1] - side("bid")[0][1]
        case ["mid"]:
            return (side("ask")[0][1] + side("bid")[0][1]) / 2
        case ["best", s, name]:
            return attribute(side(s)[0], name)
        case ["level", s, n, name]:
            return attribute(side(s)[int(n) - 1], name) if int(n) <= len(side(s)) else None
        case ["at", s, price, name]:
            return next((attribute(x, name) for x in side(s) if x[1] == number(price)), None)
        case ["cum", s, "levels", n, name]:
            return sum(attribute(x, name) for x in chosen(s, "levels", n))
        case ["range", s, by, span, "count"]:
            return len(chosen(s, by, span))
        case ["range", s, by, span, how, name]:
            values = [attribute(x, name) for x in chosen(s, by, span)]
            return {"sum": sum, "avg": mean, "min": min, "max": max}[how](values) if values else (0 if by == "price" else None)
        case ["vwap", s, by, span]:
            return sum(x[1] * x[2] for x in chosen(s, by, span)) / sum(x[2] for x in chosen(s, by, span))
        case ["imbalance", by, span]:
            bid, ask = (sum(x[2] for x in chosen(s, by, span)) for s in ("bid", "ask"))
            return (bid - ask) / (bid + ask) if bid + ask else 0
        case ["meta", "levels", s]:
            return len(side(s))


KEYS = (
    *obkeys.profile(2), "ob.cum.bid.levels.3.notional", "ob.cum.ask.levels.9.size", "ob.vwap.bid.levels.2-4", "ob.vwap.ask.price.60-61", *(f"ob.range.bid.levels.2-4.{how}.{name}" for how in ("sum", "avg", "min", "max") for name in ("size", "orders")),
    "ob.range.ask.price.60-63.sum.size", "ob.range.bid.levels.1-3.count", "ob.range.bid.price.1-2.sum.size", "ob.range.bid.levels.7-9.sum.size", "ob.imbalance.levels.2-3", "ob.imbalance.price.55-60", "ob.imbalance.price.1-2", "ob.level.ask.2.orders",
    "ob.level.ask.9.size", "ob.at.bid.55.notional", "ob.at.bid.55p5.size", "ob.meta.levels.bid", "ob.level.bid.1.orders.agg",
)


def test_metrics(ladder):
    """Every metric by expressions over the ladder, and of a replay's book, is what loops over the levels say."""
    got = obkeys.evaluate(ladder, KEYS).first().asDict()
    own = replay.Book()
    for k, (side, price, size, orders) in enumerate(LEVELS):
        for n in range(orders):
            own.add((0, 0, 100 * k + n + 1), side, price, size - (orders - 1) if n == 0 else 1)
    for key in KEYS:
        want = by_hand(key, LEVELS)
        assert same(got[key.replace(".", "_").replace("-", "_")], want), key
        if "p5" not in key:
            assert same(obkeys.value_of(obkeys.parse(key), own, 1.0), want), key


def test_empty_side(spark, ladder):
    got = obkeys.evaluate(ladder.where("side = 'bid'"), ("ob.spread", "ob.mid", "ob.best.ask.price", "ob.best.ask.size", "ob.vwap.ask.levels.3")).first()
    assert got["ob_spread"] is None and got["ob_mid"] is None and got["ob_best_ask_price"] is None and got["ob_best_ask_size"] == 0 and got["ob_vwap_ask_levels_3"] is None


def test_grammar():
    for text in [*KEYS, *obkeys.profile(), "ob.meta.seq", "ob.meta.is_stale"]:
        key = obkeys.parse(text)
        assert obkeys.parse(obkeys.format_key(key)) == key, text
    assert obkeys.parse("ob..spread.per") == obkeys.parse("ob.spread")
    assert obkeys.parse("ob.range.bid.levels.5-2.count").span == (2, 5)
    for bad in ("", "spread", "ob", "ob.level.bid.0.size", "ob.level.mid.1.size", "ob.at.bid.100.5.size", "ob.range.bid.levels.1-2.median.size", "ob.vwap.bid.levels.x", "ob.meta.foo", "ob.best.bid.orders", "ob.imbalance.levels.0-2"):
        with pytest.raises(obkeys.KeyError_):
            obkeys.parse(bad)


def test_snapshot_arrays(ladder):
    row = book.snapshot(ladder).first()
    assert [x["price"] for x in row["bids"]] == [57, 55, 52, 41] and [x["size"] for x in row["asks"]] == [8, 5, 21]
    top = book.top(ladder).first()
    assert (top["bid"], top["bid_size"], top["ask"], top["ask_size"]) == (57, 4, 60, 8)


def test_strict_ranges(ladder):
    keys = ("ob.range.bid.levels.1-3.min.size", "ob.range.bid.levels.1-3.count", "ob.range.ask.price.60-61.max.size", "ob.range.ask.price.60-61.count", "ob.range.ask.price.60-61.avg.size")
    assert tuple(obkeys.evaluate(ladder, keys, strict=True).first())[1:] == (16.0, 0.0, 0.0, 0.0, 6.5)


def test_venue_keys(spark):
    names = spark.createDataFrame([("A", "v", T0, 1, 7), ("A", "v", T0, 5, 8), ("B", "v", T0, 1, 9)], "symbol string, venue_key string, ts timestamp_ntz, seq long, order_id long")
    events_ = spark.createDataFrame([("A", "v", T0, 2, None), ("A", "v", T0, 6, None), ("A", "w", T0, 6, None), ("A", "v", T0, 7, 3)], "symbol string, venue_key string, ts timestamp_ntz, seq long, order_id long")
    got = sorted((r["seq"], r["venue_key"], r["order_id"]) for r in book.resolve_venue_keys(events_, names).collect())
    assert got == [(2, "v", 7), (6, "v", 8), (6, "w", None), (7, "v", 3)]


def test_replay_after_a_reset(spark):
    """A stale book takes a snapshot, of orders or levels, and goes on from there; a gap makes it stale."""
    add = lambda i, **x: {"kind": "add", "order_id": i, "side": "bid", "price": float(10 + i), "size": 5} | x
    rows = [add(1), {"kind": "reset", "epoch": 1}, add(2), add(3, kind="snapshot", seq=4), add(4, kind="snapshot", seq=4), add(5, kind="snapshot_level", seq=4, side="ask", price=20.0), add(6, seq=5), add(7, seq=7), add(8, seq=8)]
    own = book.quantised(events(spark, rows), tick_size=1.0)
    for sequenced, alive in ((False, {13, 14, 16, 17, 18}), (True, {13, 14, 16})):
        changes = replay.replay(own, sequenced)
        last = changes.groupBy("side", "price_ticks").agg(F.max_by("total", "number").alias("total")).where("total > 0").collect()
        assert {(r["side"], r["price_ticks"]) for r in last} == {("bid", p) for p in alive} | {("ask", 20)}
        count = replay.counters(own, sequenced).first()
        assert (count["resets"], count["snapshots"], count["gaps"], count["ignored_stale"]) == (1, 1, int(sequenced), 3 if sequenced else 1)
    stale = [(r["seq"], r["value"]) for r in replay.key_values(own, ("ob.meta.is_stale",), 1.0, True).orderBy("seq").collect()]
    assert (2, 1.0) in stale and stale[-1] == (7, 1.0) and (5, 0.0) in stale


def test_dump():
    own = replay.Book()
    own.add((0, 0, 1), "bid", 9, 5)
    own.add((0, 0, 2), "ask", 11, 3)
    own.summary("ask", 12, 4)
    assert own.dump() == [("ask", 12, 4, 0), ("ask", 11, 3, 1), ("bid", 9, 5, 1)]
