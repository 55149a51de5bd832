import json

import pytest
from helpers import T0
from pyspark.sql import functions as F

from tickloom import config, schema
from tickloom.registry import Engine, EventType
from tickloom.sources import directory, feed, itch, synthetic


def lines(spark, texts):
    return spark.createDataFrame([(i, T0, t) for i, t in enumerate(texts)], "seq long, ts timestamp_ntz, line string")


def test_classify(spark):
    good = json.dumps({"symbol": "A", "price": 1})
    rows = [good, None, "", "x", "[]", "3", json.dumps({"symbol": ""}), json.dumps({"symbol": 5}), json.dumps({"symbol": "y" * 65}), json.dumps({"symbol": "A", "type": "ob"}), json.dumps({"symbol": "A", "pad": "z" * 70_000})]
    got = [(r["type"], r["reject"]) for r in feed.classify(lines(spark, rows)).orderBy("seq").collect()]
    assert [x for _, x in got] == [None, "empty", "empty", "not an object", "not an object", "not an object", "no symbol", "no symbol", "symbol too long", None, "too long"]
    assert got[9][0] == "ob" and feed.ticks(lines(spark, rows)).count() == 1 and feed.rejects(lines(spark, rows)).count() == 9


def test_book_messages(spark):
    def ob(**x):
        return json.dumps({"symbol": "A", "type": "ob", **x})

    rows = [ob(action="add", id=1, side="ask", price=1.5, size=3), ob(action="add", id=1, side="x", price=1, size=3), ob(action="add", side="bid", price=1, size=3), ob(action="update", id=1), ob(action="update", id=1, price=2), ob(action="delete"), ob(action="delete", id=4), ob(action="trade", price=1, size=2, aggressor="sell"), ob(action="ticksize", tickSize=0.5), ob(action="dance", id=1), json.dumps({"symbol": "A", "type": "control", "action": "reset", "epoch": 3}), ob(action="add", id=1, price="7", size=1)]
    got = [(r["seq"], r["kind"], r["side"], r["price"], r["epoch"]) for r in feed.book_events(lines(spark, rows)).orderBy("seq").collect()]
    assert got == [(0, "add", "ask", 1.5, 0), (1, "add", "bid", 1.0, 0), (4, "update", None, 2.0, 0), (6, "delete", None, None, 0), (7, "trade", None, 1.0, 0), (8, "ticksize", None, None, 0), (10, "reset", None, None, 3)]
    assert feed.tick_sizes(feed.book_events(lines(spark, rows))).first()["tick_size"] == 0.5


def test_alias_priority(spark):
    rows = [({"px": 99, "lastPrice": 100}, 100.0, 0.0), ({"price": "5", "px": 4, "qty": 2}, 4.0, 2.0), ({"volume": 3}, None, None), ({"last": 1.5, "volume": True, "vol": 8}, 1.5, 8.0)]
    df = spark.createDataFrame([("A", i, T0, "tick", json.dumps(p)) for i, (p, _, _) in enumerate(rows)], schema.EVENT)
    got = {r["seq"]: (r["price"], r["volume"]) for r in schema.canonical_ticks(df).collect()}
    assert got == {i: (p, q) for i, (_, p, q) in enumerate(rows) if p is not None}


def test_quotes(spark):
    df = spark.createDataFrame([("A", 0, T0, "tick", '{"px":1,"b":400,"a":401.5,"t":17}'), ("A", 1, T0, "tick", '{"px":1,"b":-2,"a":3}')], schema.EVENT)
    got = schema.with_quotes(schema.canonical_ticks(df, config.Config(bid_fields=("b",), ask_fields=("a",), timestamp_field="t"))).orderBy("seq").collect()
    assert got[0]["spread"] == 1.5 and got[0]["ts_ns"] == 17 and got[1]["bid"] is None and got[1]["spread"] is None


def message(**x):
    names = [c.split()[0] for c in itch.MESSAGE.split(", ")]
    return tuple((dict.fromkeys(names) | {"ts": T0} | x)[n] for n in names)


def test_itch(spark):
    rows = [
        message(seq=1, type="stock_directory", stock="AAPL   ", stock_locate=7),
        message(seq=2, type="add_order", stock_locate=7, order_ref=1, side="B", shares=100, price=150.0),
        message(seq=3, type="order_executed", order_ref=1, shares=100),
        message(seq=4, type="order_executed", order_ref=1, shares=5),  # it is gone
        message(seq=5, type="add_order_mpid", stock="AAPL", order_ref=2, side="S", shares=200, price=2800.0),
        message(seq=6, type="order_executed", order_ref=2, shares=50),
        message(seq=7, type="order_replace", orig_ref=2, order_ref=3, shares=70, price=2801.0),
        message(seq=8, type="order_replace", orig_ref=3, order_ref=4, shares=60, price=2802.0),
        message(seq=9, type="order_cancel", order_ref=4, shares=10),
        message(seq=10, type="order_delete", order_ref=4),
        message(seq=11, type="order_delete", order_ref=99),
        message(seq=12, type="trade", stock_locate=7, price=1.0, shares=5, side="B"),
        message(seq=13, type="system_event"),
    ]
    got = [tuple(r) for r in itch.events(spark.createDataFrame(rows, itch.MESSAGE)).orderBy("seq", "part").select("seq", "symbol", "kind", "order_id", "side", "price", "size", "aggressor").collect()]
    assert got == [
        (1, "AAPL", "ticksize", None, None, 0.01, None, None),
        (2, "AAPL", "add", 1, "bid", 150.0, 100, None),
        (3, "AAPL", "delete", 1, "bid", None, None, None), (3, "AAPL", "trade", 1, "bid", 150.0, 100, "sell"), (3, "AAPL", "tick", 1, None, 150.0, 100, None),
        (5, "AAPL", "add", 2, "ask", 2800.0, 200, None),
        (6, "AAPL", "update", 2, "ask", None, 150, None), (6, "AAPL", "trade", 2, "ask", 2800.0, 50, "buy"), (6, "AAPL", "tick", 2, None, 2800.0, 50, None),
        (7, "AAPL", "delete", 2, "ask", None, None, None), (7, "AAPL", "add", 3, "ask", 2801.0, 70, None),
        (8, "AAPL", "delete", 3, "ask", None, None, None), (8, "AAPL", "add", 4, "ask", 2802.0, 60, None),
        (9, "AAPL", "update", 4, "ask", None, 50, None), (10, "AAPL", "delete", 4, "ask", None, None, None),
        (12, "AAPL", "trade", None, None, 1.0, 5, "buy"), (12, "AAPL", "tick", None, None, 1.0, 5, None),
    ]
    gone = [message(seq=1, type="add_order", stock="A", order_ref=1, side="B", shares=5, price=1.0), message(seq=2, type="order_delete", order_ref=1), message(seq=3, type="order_replace", orig_ref=1, order_ref=2, shares=5, price=2.0), message(seq=4, type="order_replace", orig_ref=2, order_ref=3, shares=5, price=2.0)]
    got = itch.events(spark.createDataFrame(gone, itch.MESSAGE)).select("seq", "kind", "order_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, "add", 1), (2, "delete", 1)]  # what replaces an order that is gone does nothing
    text = lines(spark, ['{"type":"add_order","stock":"A ","orderRef":5,"side":"B","shares":3,"price":"1.25"}'])
    assert itch.parse(text).select("stock", "order_ref", "price").first() == ("A", 5, 1.25)


def test_synthetic(spark):
    got = synthetic.waves(synthetic.counters(spark, 3).withColumn("counter", F.get_json_object("payload", "$.counter").cast("double"))).orderBy("seq").collect()
    assert got[0]["synthetic_cos"] == 1 and abs(got[2]["synthetic_sin"] - 0.19866933) < 1e-6
    assert synthetic.random_walk(spark, 5).count() == 10


def test_directory():
    text = json.dumps([{"name": "a", "protocol": "itch", "endpointUrl": "ws://x"}, {"name": "b", "protocol": "fix", "endpointUrl": "u"}, {"name": "c", "protocol": "ITCH", "endpointUrl": "u", "symbols": ["A", 3]}, {"protocol": "itch"}, 5])
    assert directory.entries(text) == [directory.Ingress("a", "itch", "ws://x", ("*",)), directory.Ingress("c", "itch", "u", ("A",))]
    assert directory.entries("nonsense") == []


def test_config():
    seen = {}
    own = config.load("# note\n; note\ntaSMA = 3, 7\ntaMACD_fast=30\ntaMACD_slow = 10\ntaBBands_stdK=-1\ntaRSI = x\ntaATR=0\nmarket.other = 5\ntaEMA=\nnoise\nmarket.source.bidFields = b, bb\nsource.priceFields =\nallowNegativePrices = yes", {"market": lambda k, v: seen.update({k: v})})
    assert own.sma == (3, 7) and (own.macd_fast, own.macd_slow) == (10, 30) and own.band_width == 2.0 and own.rsi == 14 and own.atr == 1 and own.ema == (12, 26) and own.bid_fields == ("b", "bb") and own.price_fields[0] == "lastPrice" and own.negative_prices
    assert seen == {"market.other": "5"} and own.parked == seen


def test_engine(spark):
    engine, calls = Engine(), []

    class Plug:
        def __init__(self, name):
            self.name = name

        def register_with(self, e):
            e.register_source(self.name, lambda s, p: s.range(p.get("n", 1)))
            e.register_computer(self.name, lambda c: lambda df: df.groupBy("type").count())

        def start(self):
            calls.append(f"+{self.name}")

        def stop(self):
            calls.append(f"-{self.name}")

    with engine.running(Plug("a"), Plug("b")):
        assert engine.read(spark, "a", {"n": 4}).count() == 4
    assert calls == ["+a", "+b", "-b", "-a"]
    events = spark.createDataFrame([("a",), ("a",), ("z",)], "type string")
    assert engine.compute(events)["a"].first()["count"] == 2
    with pytest.raises(ValueError):
        engine.register_source("a", None)
    with pytest.raises(KeyError):
        engine.read(spark, "none")
    engine.register_event_type(EventType("a", events.schema))
    engine.register_settings("x", lambda k, v: calls.append(v))
    engine.configure("x.y = 3")
    assert calls[-1] == "3"
