"""Every reducer over frames, groups and arrays against the row-at-a-time oracle."""

import random

import pytest
from helpers import ORACLE, same, stream
from pyspark.sql import functions as F

from tickloom.functions import FUNCTIONS, PLAIN, ArrayBasis, FunctionRegistry
from tickloom.operators import nodes

CAP = 7


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    pool = [0.0, 1.0, -1.0, 2.5, -2.5, 0.5, 0.51, 1e-7, 3.25, -0.75]
    return [(s, pick.choice([*pool, round(pick.uniform(-4, 4), 3)])) for _ in range(60) for s in ("A", "B")]


def test_all_have_an_oracle():
    assert set(PLAIN) == set(ORACLE) and len(PLAIN) == 54


def test_frames(spark, rows):
    found = nodes.work_many(stream(spark, rows), PLAIN, CAP).orderBy("seq").collect()
    seen = {"A": [], "B": []}
    for r, (symbol, value) in zip(found, rows, strict=True):
        seen[symbol] = [*seen[symbol], value][-CAP:]
        for name, f in ORACLE.items():
            assert same(r[name], f(seen[symbol])), (name, seen[symbol], r[name])


def test_groups_and_arrays(spark, rows):
    own = stream(spark, rows)
    fused = {(r["symbol"], r["ts"]): r for r in nodes.tumble_reduce(own, 10_000, PLAIN).collect()}
    vectors = nodes.tumble(own, 10_000)
    basis = ArrayBasis(F.col("value"))
    apart = vectors.select("symbol", "ts", "value", *(f(basis).alias(n) for n, f in PLAIN.items())).collect()
    assert len(apart) == len(fused) and sum(len(r["value"]) for r in apart) == len(rows)
    for r in apart:
        for name, f in ORACLE.items():
            assert same(r[name], f(r["value"])), (name, r["value"])
            assert same(fused[r["symbol"], r["ts"]][name], f(r["value"])), ("group", name, r["value"])


def test_empty_array_is_zero(spark):
    one = spark.range(1).select(F.array().cast("array<double>").alias("v"))
    got = one.select(*(PLAIN[n](ArrayBasis(F.col("v"))).alias(n) for n in ("mean", "sum", "product", "min", "max", "last", "first", "count", "median", "and", "or"))).first()
    assert all(x == 0 for x in got)


def test_registry(spark):
    own = FunctionRegistry()
    own.register("twice", lambda b: b.last * 2)
    own.register_python("py_sum", lambda v: sum(v))
    own.register_parametric("plus", lambda b, p: b.last + p["by"])
    s = stream(spark, [("A", 1), ("A", 2)])
    assert [r["value"] for r in nodes.work(s, own.resolve("twice")).orderBy("seq").collect()] == [2, 4]
    assert [r["value"] for r in nodes.work(s, own.resolve("py_sum")).orderBy("seq").collect()] == [1, 3]
    assert [r["value"] for r in nodes.work(s, own.resolve("plus", {"by": 5.0})).orderBy("seq").collect()] == [6, 7]
    with pytest.raises(KeyError):
        own.resolve("nothing")
    with pytest.raises(KeyError):
        FUNCTIONS.resolve("scale", plain_only=True)
