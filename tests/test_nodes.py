import datetime as dt
import random

import pytest
from helpers import T0, stream, ticks
from pyspark.sql import functions as F

from tickloom.functions import FUNCTIONS, PLAIN, FrameBasis
from tickloom.operators import nodes, ta
from tickloom.operators.asof import asof
from tickloom.operators.blocks import over_blocks, with_blocks
from tickloom.schema import coerce, first_symbols


def values(df):
    return [r["value"] for r in df.orderBy("ts", "seq", "pos").collect()]


def test_worker_counts(spark):
    assert values(nodes.work(stream(spark, [("A", 1), ("A", 2), ("A", 3)]), PLAIN["count"])) == [1, 2, 3]


def test_batches_then_running_sum(spark):
    s = stream(spark, [("A", 10), ("A", 20), ("A", 5)])
    assert values(nodes.work(nodes.batch([s], 2), PLAIN["sum"])) == [10, 30]


def test_batches_keep_symbols_apart(spark):
    s = stream(spark, [("X", 1), ("Y", 2), ("X", 3), ("Y", 4), ("Y", 5)])
    got = [(r["symbol"], r["value"]) for r in nodes.batch([s], 2).orderBy("ts", "seq", "pos").collect()]
    assert sorted(got) == [("X", 1), ("X", 3), ("Y", 2), ("Y", 4)]
    with pytest.raises(ValueError):
        nodes.batch([s], 0)


def test_window_then_max(spark):
    s = stream(spark, [("A", v) for v in (1, 2, 3, 4, 5)])
    out = nodes.reduce_vector(nodes.tumble(s, 60_000), PLAIN["max"]).collect()
    assert [(r["value"], r["ts"]) for r in out] == [(5.0, T0 + dt.timedelta(minutes=1))]


def test_reducer_drops_what_is_no_vector(spark):
    assert nodes.reduce_vector(stream(spark, [("A", 1)]), PLAIN["max"]).count() == 0


def test_period_limits(spark):
    for bad in (0, 3_600_001):
        with pytest.raises(ValueError):
            nodes.tumble(stream(spark, [("A", 1)]), bad)


def test_timers(spark):
    s = stream(spark, [("A", 1), ("A", 2), ("A", 3), ("A", 4)]).withColumn("ts", F.col("ts") + F.expr("interval 500 milliseconds"))
    plain = [r["ts"] for r in nodes.interval(s, 1000).orderBy("ts").collect()]
    aligned = [r["ts"] for r in nodes.bucket_time(s, 1000).orderBy("ts").collect()]
    assert plain == [T0 + dt.timedelta(milliseconds=500 + 1000 * k) for k in (1, 2, 3)]
    assert aligned == [T0 + dt.timedelta(seconds=k) for k in (1, 2, 3)]


@pytest.mark.parametrize("bucket", [1, 7, 86_400])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof(spark, bucket, inclusive):
    pick = random.Random(bucket)
    left = [(pick.choice("AB"), pick.randrange(40), k) for k in range(30)]
    right = [(pick.choice("AB"), pick.randrange(40), k, pick.choice([None, float(k)])) for k in range(25)]
    at = lambda s: T0 + dt.timedelta(seconds=s)
    a = spark.createDataFrame([(k, at(t), q) for k, t, q in left], "symbol string, ts timestamp_ntz, seq long")
    b = spark.createDataFrame([(k, at(t), q, v) for k, t, q, v in right], "symbol string, ts timestamp_ntz, seq long, value double")
    want = []
    for k, t, q in left:
        before = [(t2, q2, v) for k2, t2, q2, v in right if k2 == k and v is not None and ((t2, q2) <= (t, q) if inclusive else (t2, q2) < (t, q))]
        want.append((k, q, max(before)[2] if before else None))
    got = [(r["symbol"], r["seq"], r["found"]) for r in asof(a, b, ("symbol",), inclusive, bucket, keep_unmatched=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_equal_whole_sequences(spark):
    pick = random.Random(5)
    rows = ticks(spark, [(pick.choice("AAAB"), float(pick.randrange(1, 50)), float(pick.randrange(9))) for _ in range(600)]).withColumn("pos", F.lit(0))

    def run(df, keys):
        b = FrameBasis(F.col("price"), 11, keys)
        return df.select("symbol", "seq", *[c for c in ("block", "halo") if c in df.columns], b.mean.alias("mean"), b.first.alias("first"), b.n.alias("n"))

    whole = sorted(map(tuple, run(rows, ("symbol",)).collect()))
    blocked = over_blocks(rows, 11, run, target=1, bucket_seconds=7)
    assert sorted(map(tuple, blocked.collect())) == whole
    parts = with_blocks(rows, 11, 1, 7)
    assert parts.select("symbol", "block").distinct().count() > 6
    assert parts.where("not halo").count() == 600 and parts.where("halo").count() < 600


def test_coercion(spark):
    row = spark.range(1).select(F.lit(True).alias("b"), F.lit(3).alias("i"), F.lit("7").alias("s"), F.array(F.lit(1.0)).alias("v"))
    got = row.select(*(coerce(row.schema[c].dataType, F.col(c)).alias(c) for c in row.columns)).first()
    assert tuple(got) == (1.0, 3.0, 0.0, 0.0)


def test_access_is_silent_without_a_value(spark):
    s = stream(spark, [("A", 1), ("A", 2)])
    store = stream(spark, [("B", 9)]).withColumn("ts", F.col("ts") + F.expr("interval 1 second"))
    got = nodes.access(s, store, "B").collect()
    assert [(r["symbol"], r["value"]) for r in got] == [("B", 9.0)]


def test_first_symbols(spark):
    s = stream(spark, [("C", 1), ("A", 1), ("B", 1), ("A", 2)])
    assert {r["symbol"] for r in first_symbols(s, 2).collect()} == {"C", "A"} and first_symbols(s, 0).count() == 4


def test_frames_say_null_for_nan(spark):
    s = stream(spark, [("A", 1)]).withColumn("value", F.lit(float("nan")))
    assert nodes.frames(nodes.respond(s, 7)).first()["frame"] == '{"type":"update","key":7,"streamKey":"A"}'
    assert nodes.frames(nodes.respond(stream(spark, [("A", 1)]), "x")).first()["frame"] == '{"type":"update","requestId":"x","streamKey":"A","value":1.0}'


def test_scale_is_last_times_factor(spark):
    got = values(nodes.work(stream(spark, [("A", 2), ("A", 3)]), FUNCTIONS.resolve("scale", {"factor": 10})))
    assert got == [20, 30]


def test_store_field_periods(spark):
    t = ticks(spark, [("A", float(k), 1.0) for k in range(1, 30)])
    assert [r["value"] for r in ta.store_field(t, "sma_3").orderBy("seq").collect()][:2] == [2.0, 3.0]
    with pytest.raises(KeyError):
        ta.store_field(t, "no_such")


def test_timers_count_from_the_nearest_millisecond(spark):
    s = stream(spark, [("A", 1), ("A", 2), ("A", 3)]).withColumn("ts", F.col("ts") + F.expr("interval 373896 microseconds"))
    got = [r["ts"] for r in nodes.interval(s, 1000).orderBy("ts").collect()]
    assert got == [T0 + dt.timedelta(milliseconds=374 + 1000 * k) for k in (1, 2)]
