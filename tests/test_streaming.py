"""The same request over a stream of files and as a batch."""

import datetime as dt
import random

import pytest
from helpers import ORACLE, T0, same, ticks
from pyspark.sql import functions as F

from tickloom.config import Config
from tickloom.functions import PLAIN
from tickloom.operators import book, nodes, replay, ta
from tickloom.plans.compile import Catalog, Compiler
from tickloom.plans.tree import RequestError
from tickloom.schema import BOOK_EVENT
from tickloom.streaming import requests, sources, state, windows
from tickloom.streaming.session import Bucket, Session

TICK = "symbol string, seq long, ts timestamp, price double, volume double, value double"


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(8)
    return [(pick.choice("AB"), i, T0 + dt.timedelta(seconds=3 * i), v := round(pick.uniform(1, 9), 2), 1.0, v) for i in range(120)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ticks") / "in")
    for k in range(3):  # three files, in order
        spark.createDataFrame(rows[40 * k : 40 * k + 40], TICK).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).collect()


def test_running(spark, folder, rows, tmp_path):
    got = {r["seq"]: r["value"] for r in run(spark, state.running(sources.parquet_stream(spark, folder, TICK, 1), ORACLE["stddev"], 10), tmp_path, "running")}
    batch = spark.createDataFrame(rows, TICK).withColumn("pos", F.lit(0))
    want = {r["seq"]: r["value"] for r in nodes.work(batch, PLAIN["stddev"], 10).collect()}
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)


def test_batched(spark, folder, rows, tmp_path):
    got = sorted((r["symbol"], r["seq"], r["pos"], r["value"]) for r in run(spark, state.batched(sources.parquet_stream(spark, folder, TICK, 1), 7), tmp_path, "batched"))
    want = nodes.batch([spark.createDataFrame(rows, TICK).withColumn("pos", F.lit(0)).select("symbol", "ts", "seq", "pos", "value")], 7)
    assert got == sorted((r["symbol"], r["seq"], r["pos"], r["value"]) for r in want.collect())


def test_indicators(spark, folder, rows, tmp_path):
    got = {r["seq"]: r for r in run(spark, state.indicators(sources.parquet_stream(spark, folder, TICK, 1), 5, 20), tmp_path, "ind")}
    own = spark.createDataFrame(rows, TICK)
    config = Config(history=20, sma=(5,), ema=(5,), momentum=5)
    for r in ta.full_suite(own, config).collect():
        for a, b in (("sma", "sma_5"), ("ema", "ema_5"), ("momentum", "momentum_5")):
            x, y = got[r["seq"]][a], r[b]
            x, y = (None if v is None or v != v else v for v in (x, y))
            assert same(x, y), (r["seq"], a)


def test_windows_close_by_watermark(spark, folder, rows, tmp_path):
    got = {(r["symbol"], r["ts"]): r["high"] for r in run(spark, windows.tumble_reduce(sources.parquet_stream(spark, folder, TICK, 1), 60_000, {"high": PLAIN["max"]}), tmp_path, "win")}
    batch = nodes.tumble_reduce(spark.createDataFrame(rows, TICK).withColumn("pos", F.lit(0)), 60_000, {"high": PLAIN["max"]}).collect()
    want = {(r["symbol"], r["ts"]): r["high"] for r in batch}
    assert got and set(got.items()) <= set(want.items()) and len(want) - len(got) <= 4


def test_books(spark, tmp_path):
    pick = random.Random(1)
    rows = [("A", i + 1, T0, pick.choice(["add", "add", "delete", "trade"]), 0, 0, pick.randrange(1, 20), pick.choice(["bid", "ask"]), float(pick.randrange(90, 110)), pick.randrange(1, 9), None, pick.choice(["buy", "sell"]), None) for i in range(150)]
    path = str(tmp_path / "in")
    schema = BOOK_EVENT.replace("timestamp_ntz", "timestamp")
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(path)
    live = book.quantised(sources.parquet_stream(spark, path, schema, 1), 1.0)
    got = sorted(map(tuple, run(spark, state.book_changes(live), tmp_path, "books")), key=str)
    want = sorted(map(tuple, replay.replay(book.quantised(spark.createDataFrame(rows, schema), 1.0)).collect()), key=str)
    assert got == want and len(want) > 80


def test_session(spark, folder, rows, tmp_path):
    own = Session(Compiler(Catalog(spark.createDataFrame(rows, TICK))), Bucket(2, 0.0))
    answers = own.handle('{"type":"subscribe","requests":[{"key":1,"streamKey":"A","field":"lastPrice"},{"id":"b","streamKey":"A","field":"lastPrice","pipeline":[{"type":"Worker","fn":"no"}]},{"key":2,"field":"x"}]}')
    assert [(a["type"], a.get("where")) for a in answers] == [("subscribed", None), ("error", "build"), ("error", "validate")]
    assert own.updates(1).count() == sum(r[0] == "A" for r in rows)
    seen = []
    own.start(1, sources.parquet_stream(spark, folder, TICK), str(tmp_path / "s"), lambda df, k: seen.append(df.count())).awaitTermination(120)
    assert sum(seen) == len(rows)
    assert own.handle('{"type":"cancel","keys":[1, 5]}') == [{"type": "canceled", "key": 1}, {"type": "error", "where": "cancel", "message": "no request 5"}]
    assert own.handle("no")[0]["where"] == "parse" and own.handle("{}")[0]["where"] == "type"
    own.handle('{"type":"subscribe","requests":[]}')
    assert own.handle('{"type":"subscribe","requests":[]}')[0]["where"] == "rate"


def test_a_bad_cancel_is_answered(spark):
    session = Session(Compiler(Catalog(ticks(spark, [("A", 1.0, 1.0)]))))
    for message in ('{"type":"cancel","keys":5}', '{"type":"cancel","ids":[[1]]}'):
        assert session.handle(message)[0]["where"] == "cancel"


def test_requests_run_on_streams(spark, folder, rows, tmp_path):
    """A request gives the same on a stream of ticks as in batch, value by value."""
    batch = Compiler(Catalog(spark.createDataFrame(rows, TICK), config=Config(history=10)))
    for k, pipeline in enumerate(([{"type": "Worker", "fn": "stddev"}, {"type": "Worker", "fn": "scale", "factor": 2}], [{"type": "Worker", "fn": "ema_weight"}], [{"type": "Worker", "fn": "sqrt"}])):
        spec = {"key": k, "streamKey": "A", "field": "lastPrice", "pipeline": pipeline}
        got = run(spark, requests.live(batch, spec, sources.parquet_stream(spark, folder, TICK, 1)), tmp_path, f"live{k}")
        want = batch.compile(spec).collect()
        by_time = lambda own: {r["ts"].replace(tzinfo=None): r["value"] for r in own}
        got, want = by_time(got), by_time(want)
        assert got.keys() == want.keys() and all(same(got[t], want[t]) for t in want)
    window = {"key": 9, "streamKey": "A", "field": "lastPrice", "pipeline": [{"type": "TumblingWindow", "periodMs": 60000}, {"type": "VectorReducer", "fn": "max"}]}
    got = {r["ts"].replace(tzinfo=None): r["value"] for r in run(spark, requests.live(batch, window, sources.parquet_stream(spark, folder, TICK, 1)), tmp_path, "live9")}
    want = {r["ts"]: r["value"] for r in batch.compile(window).collect()}
    assert got and all(want[t] == v for t, v in got.items())
    for bad in ([{"type": "TumblingWindow", "periodMs": 60000}, {"type": "VectorReducer", "fn": "max"}, {"type": "Worker", "fn": "sum"}], [{"type": "AtomicAccessor", "field": "lastPrice"}]):
        with pytest.raises(RequestError):
            requests.live(batch, window | {"pipeline": bad}, sources.parquet_stream(spark, folder, TICK))
