import json

import pytest
from helpers import ticks
from pyspark.sql import functions as F

from tickloom.plans.compile import Catalog, Compiler
from tickloom.plans.rewrite import rewrite
from tickloom.plans.tree import Chain, Fused, Parser, RequestError, Worker, check_document, check_json

P = Parser()


@pytest.fixture(scope="module")
def compiler(spark):
    return Compiler(Catalog(ticks(spark, [("A", 1.0, 5.0), ("B", 7.0, 1.0), ("A", 3.0, 6.0), ("B", 9.0, 1.0), ("A", 2.0, 7.0), ("A", 8.0, 8.0)])))


def run(compiler, **spec):
    return [r["value"] for r in compiler.compile({"key": 1, "streamKey": "A", "field": "lastPrice", **spec}).orderBy("ts").collect()]


def test_head_alone(compiler):
    assert run(compiler) == [1, 3, 2, 8]


def test_pipeline_runs_in_array_order(compiler):
    assert run(compiler, pipeline=[{"type": "Worker", "fn": "sum"}, {"type": "Worker", "fn": "scale", "factor": 10}, {"type": "Worker", "fn": "max"}]) == [10, 40, 60, 140]


def test_pipeline_wins_over_stages(compiler):
    assert run(compiler, pipeline=[{"type": "Worker", "fn": "count"}], stages=[{"type": "Worker", "fn": "neg"}]) == [1, 2, 3, 4]


def test_symbol_is_an_alias_of_stream_key(compiler):
    got = compiler.compile({"id": "q", "symbol": "B", "field": "price"}).collect()
    assert {(r["key"], r["requestId"], r["symbol"]) for r in got} == {(None, "q", "B")}


def test_node_and_pipeline_are_both_live(compiler):
    node = {"type": "Aggregate", "arity": 2, "inputs": [{"type": "Listener", "field": "volume"}]}
    pipeline = [{"type": "Worker", "fn": "neg"}]
    assert sorted(run(compiler, node=node, pipeline=pipeline)) == [-8, -3, -2, -1, 5, 6, 7, 8]
    composed = compiler.compile({"key": 1, "streamKey": "A", "field": "lastPrice", "node": node, "pipeline": pipeline}, compose=True)
    assert sorted(r["value"] for r in composed.collect()) == [-8, -7, -6, -5]


def test_aggregate_ignores_upstream_and_warns(compiler):
    spec = {"type": "Aggregate", "arity": 3, "inputs": [{"type": "Listener", "field": "volume"}]}
    assert run(compiler, pipeline=[spec]) == [5, 6, 7]
    assert P.request({"key": 1, "streamKey": "A", "field": "f", "pipeline": [spec]}).warnings


def test_split_and_chain_vanish():
    chain = Chain((Worker("mean"), Chain((Worker("scale", (("factor", 2.0),)), Worker("scale", (("factor", 3.0),))))))
    assert rewrite((chain,)) == (Worker("mean"), Worker("scale", (("factor", 6.0),)))
    own = P.node({"type": "SymbolSplit", "child": {"type": "Chain", "stages": [{"type": "TumblingWindow", "ms": 5}, {"type": "VectorReducer", "fn": "max"}]}}, "A")
    assert rewrite((own,)) == (Fused(5, "max"),)


def test_accessor_reads_indicators_of_the_same_tick(compiler):
    assert run(compiler, pipeline=[{"type": "AtomicAccessor", "field": "prevClose"}]) == [1, 3, 2]
    assert run(compiler, pipeline=[{"type": "AtomicAccessor", "streamKey": "B", "field": "lastPrice"}]) == [7, 9, 9]
    assert run(compiler, pipeline=[{"type": "AtomicAccessor", "field": "fn.lastPrice.sum"}]) == [1, 4, 6, 14]


def test_indicators_are_fields(compiler):
    assert run(compiler, field="prevClose") == [1, 3, 2]


def test_timers(compiler):
    assert run(compiler, node={"type": "Interval", "ms": 2000, "child": {"type": "AtomicAccessor", "field": "lastPrice"}}) == [3, 2]
    assert [r["value"] for r in compiler.simple("A", "lastPrice", 2000).orderBy("ts").collect()] == [3, 2]


def test_filter_and_columns_reach_the_scan(spark, sf):
    from tickloom.sources.ticks import event_ticks

    plan = Compiler(Catalog(event_ticks(spark, f"{sf}/events.parquet"))).compile({"key": 1, "streamKey": "view", "field": "price"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in text and "props" not in text and "Exchange" not in text


def test_fused_windows_build_no_vector(compiler):
    plan = compiler.compile({"key": 1, "streamKey": "A", "field": "price", "pipeline": [{"type": "TumblingWindow", "ms": 1000}, {"type": "VectorReducer", "fn": "max"}]})
    assert "collect_list" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_custom_nodes_and_providers(spark):
    def double(upstream, spec, symbol):
        return upstream.withColumn("value", F.col("value") * spec["by"])

    catalog = Catalog(ticks(spark, [("A", 1.0, 1.0), ("A", 2.0, 1.0)]))
    catalog.builders["Times"] = double
    catalog.providers["ext"] = lambda symbol, key: catalog.ticks.select("ts", "seq", (F.col("price") * 100).alias("value"))
    own = Compiler(catalog)
    assert run(own, pipeline=[{"type": "Times", "by": 4}]) == [4, 8]
    assert run(own, pipeline=[{"type": "AtomicAccessor", "field": "ext.x"}]) == [100, 200]
    with pytest.raises(RequestError):
        own.parser.register("Worker")


def test_accessors_below_a_split_read_each_symbol(spark):
    own = Compiler(Catalog(ticks(spark, [("A", 1.0, 1.0), ("B", 7.0, 1.0), ("A", 3.0, 1.0), ("B", 9.0, 1.0)])))
    tree = {"type": "Aggregate", "arity": 1, "inputs": [{"type": "Listener", "streamKey": s, "field": "lastPrice"} for s in "AB"]}
    split = {"type": "GroupSplit", "child": {"type": "AtomicAccessor", "field": "lastPrice"}}
    found = own.chain((own.parser.node(tree, "A"), own.parser.node(split, "A")), None, "A")
    assert [(r["symbol"], r["value"]) for r in found.orderBy("ts", "seq", "pos").collect()] == [("A", 1), ("B", 7), ("A", 3), ("B", 9)]


def test_inputs_may_be_chains_and_splits(spark):
    own = Compiler(Catalog(ticks(spark, [("A", 1.0, 1.0), ("A", 3.0, 1.0)])))
    listener = {"type": "Listener", "streamKey": "A", "field": "lastPrice"}
    chain = {"type": "Chain", "stages": [listener, {"type": "Worker", "fn": "scale", "factor": 10}]}
    split = {"type": "Chain", "stages": [listener, {"type": "GroupSplit", "child": {"type": "Worker", "fn": "sum"}}]}
    found = own.tree({"type": "Aggregate", "arity": 2, "inputs": [chain, split]}, "A")
    assert [r["value"] for r in found.orderBy("ts", "seq", "pos").collect()] == [10, 1, 30, 4]


def test_a_wrapped_timer_is_a_source(spark):
    own = Compiler(Catalog(ticks(spark, [("A", float(k), 1.0) for k in range(5)])))
    timer = {"type": "Interval", "periodMs": 1000, "child": {"type": "AtomicAccessor", "field": "lastPrice"}}
    spec = {"key": 1, "streamKey": "A", "field": "lastPrice", "pipeline": [{"type": "Worker", "fn": "last"}]}
    plain, wrapped = (sorted(r["value"] for r in own.compile(spec | {"node": node}).collect()) for node in (timer, {"type": "Chain", "stages": [timer]}))
    assert plain == wrapped and len(plain) == 9


def test_unknown_fields_and_bad_texts_are_request_errors(spark):
    own = Compiler(Catalog(ticks(spark, [("A", 1.0, 1.0)])))
    for field in ("ob.spread", "nothing", "fn.price.nope", "fn.nothing.sum"):
        with pytest.raises(RequestError):
            run(own, pipeline=[{"type": "AtomicAccessor", "field": field}])
    with pytest.raises(RequestError):
        own.parser.request("{broken")


@pytest.mark.parametrize(
    "spec,where",
    [
        ({"key": 1, "field": "f"}, "validate"),
        ({"key": 1, "streamKey": "x" * 65, "field": "f"}, "validate"),
        ({"key": 1, "streamKey": "A", "field": "x" * 129}, "validate"),
        ({"key": True, "streamKey": "A", "field": "f"}, "validate"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "Nope"}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "Worker", "fn": "nope"}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "VectorReducer", "fn": "scale"}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "TumblingWindow", "ms": 0}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "TumblingWindow", "ms": 3_600_001}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "Aggregate", "arity": 0, "inputs": [{"type": "Listener", "field": "f"}]}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "Aggregate", "arity": 1, "inputs": []}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "Chain", "stages": []}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "pipeline": [{"type": "Listener", "field": "ob.spread"}]}, "build"),
        ({"key": 1, "streamKey": "A", "field": "f", "x": ["a"] * 65}, "validate"),
        ({"key": 1, "streamKey": "A", "field": "f", "x": "a" * 4097}, "validate"),
    ],
)
def test_rejections(spec, where):
    with pytest.raises(RequestError) as e:
        P.request(json.dumps(spec))
    assert e.value.where == where


def test_depth_and_documents():
    deep = {}
    for _ in range(40):
        deep = {"x": deep}
    with pytest.raises(RequestError):
        check_json(deep)
    check_document({"id": "a", "tree": {}})
    for bad in ({"id": "", "tree": {}}, {"tree": {}}, {"id": "a", "tree": []}):
        with pytest.raises(RequestError):
            check_document(bad)
    assert P.node({"type": "Listener", "field": "obesity"}, "A").field == "obesity"
