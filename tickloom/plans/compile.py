"""Requests to lazy DataFrames over a catalog of tick tables, stores and providers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import Config
from tickloom.functions import FUNCTIONS, FunctionRegistry
from tickloom.operators import nodes, ta
from tickloom.plans.rewrite import rewrite
from tickloom.plans.tree import Accessor, Aggregate, Custom, Fused, Listener, Node, Parser, Request, RequestError, Timer, Tumbling, Vector, Worker

#: From (symbol or None for all, key) to (symbol, ts, seq, value).
Provider = Callable[[str | None, str], DataFrame]
#: From (upstream or None, spec, default symbol) to a stream.
Builder = Callable[[DataFrame | None, dict, str], DataFrame]


@dataclass
class Catalog:
    """ticks: symbol, ts, seq and a column per payload field (price and volume feed the indicators)."""

    ticks: DataFrame
    config: Config = field(default_factory=Config)
    functions: FunctionRegistry = field(default_factory=lambda: FUNCTIONS)
    providers: dict[str, Provider] = field(default_factory=dict)
    builders: dict[str, Builder] = field(default_factory=dict)
    #: Payload fields that go by another name in the tick table.
    fields: dict[str, str] = field(default_factory=lambda: {"lastPrice": "price"})

    def of(self, symbol: str | None) -> DataFrame:
        return self.ticks if symbol is None else self.ticks.where(F.col("symbol") == symbol)

    def store(self, symbol: str | None, name: str) -> DataFrame:
        """(symbol, ts, seq, value): what the store held under a name, after each tick: a field, an indicator, fn.<field>.<function>, or a provider's key.

        Without a symbol it is that of every one. A name that nothing is kept under raises RequestError.
        """
        try:
            return self._store(symbol, name)
        except (KeyError, ValueError) as e:
            raise e if isinstance(e, RequestError) else RequestError("build", str(e.args[0] if e.args else e)) from None

    def _store(self, symbol: str | None, name: str) -> DataFrame:
        if name in self.fields:
            name = self.fields[name]
        space = name.partition(".")[0]
        if name.startswith("fn."):
            own, _, fn = name[3:].partition(".")
            if self.fields.get(own, own) not in self.ticks.columns:
                raise KeyError(f"unknown field {own!r}")
            return nodes.work(nodes.listen(self.ticks, self.fields.get(own, own), symbol), self.functions.resolve(fn, plain_only=True), self.config.history).drop("pos")
        if space in self.providers and "." in name:
            return self.providers[space](symbol, name).select((F.col("symbol") if symbol is None else F.lit(symbol)).alias("symbol"), "ts", "seq", "value")
        return ta.store_field(self.of(symbol), name, self.config)


class Compiler:
    """One catalog's requests as plans."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.parser = Parser(catalog.functions)
        for kind in catalog.builders:
            self.parser.register(kind)

    def listener(self, node: Listener) -> DataFrame:
        name = self.catalog.fields.get(node.field, node.field)
        if name in self.catalog.ticks.columns:
            return nodes.listen(self.catalog.ticks, name, node.symbol)
        if node.symbol is None:
            raise RequestError("build", "an indicator is listened to by stream key")
        return self.catalog.store(node.symbol, name).select("symbol", "ts", "seq", F.lit(0).alias("pos"), "value")

    def stage(self, node: Node, upstream: DataFrame | None, symbol: str) -> DataFrame:
        """A node's output; upstream None makes it a source, which is what some nodes always are."""
        c = self.catalog
        if isinstance(node, Listener):
            own = self.listener(node)
            return own if upstream is None else nodes.union_inputs([own, upstream])
        if isinstance(node, Aggregate):
            return nodes.batch([self.chain((x,), None, symbol) for x in node.inputs], node.arity)
        if isinstance(node, Timer):
            source = nodes.bucket_time if node.aligned else nodes.interval
            ticks = source(c.of(symbol), node.period_ms)
            return ticks if node.child is None else self.chain((node.child,), ticks, symbol)
        if isinstance(node, Custom):
            return c.builders[node.kind](upstream, json.loads(node.spec), symbol)
        if upstream is None:
            upstream = nodes.listen(c.ticks, "price", symbol)
        if isinstance(node, Worker):
            return nodes.work(upstream, c.functions.resolve(node.fn, dict(node.parameters)), c.config.history)
        if isinstance(node, Accessor):
            if node.each:
                return nodes.access_same(upstream, c.store(None, node.field))
            own = node.symbol or symbol
            return nodes.access(upstream, c.store(own, node.field), own)
        if isinstance(node, Tumbling):
            return nodes.tumble(upstream, node.period_ms)
        if isinstance(node, Vector):
            return nodes.reduce_vector(upstream, c.functions.resolve(node.fn, plain_only=True))
        if isinstance(node, Fused):
            return nodes.tumble_reduce(upstream, node.period_ms, {"value": c.functions.resolve(node.fn, plain_only=True)})
        raise RequestError("build", f"can't compile {type(node).__name__}")

    def chain(self, stages: tuple[Node, ...], upstream: DataFrame | None, symbol: str) -> DataFrame:
        for node in rewrite(stages):
            upstream = self.stage(node, upstream, symbol)
        return upstream

    def stream(self, request: Request, compose: bool = False) -> DataFrame:
        """The request's stream. A node and a pipeline are both live, and their values are united; compose feeds the one into the other."""
        head = self.listener(Listener(request.field, request.symbol))
        if request.node is not None and request.pipeline:
            if compose:
                return self.chain((request.node, *request.pipeline), head, request.symbol)
            sources = isinstance(rewrite((request.node,))[0], (Aggregate, Timer))  # however it is wrapped
            piped = self.chain(request.pipeline, head, request.symbol)
            return nodes.union_inputs([nodes.numeric(self.chain((request.node,), None, request.symbol)), nodes.numeric(piped)]) if sources else piped
        return self.chain((request.node,) if request.node is not None else request.pipeline, head, request.symbol)

    def compile(self, spec: dict | str, compose: bool = False) -> DataFrame:
        """(key, requestId, symbol, ts, value) of a request's JSON."""
        request = self.parser.request(spec)
        return nodes.respond(self.stream(request, compose), request.key)

    def tree(self, spec: dict, symbol: str) -> DataFrame:
        """A bare subtree, without a listener at its head."""
        return self.chain((self.parser.node(spec, symbol),), None, symbol)

    def simple(self, symbol: str, name: str, poll_ms: int | None = None) -> DataFrame:
        """The latest value of a field, at every tick or polled."""
        trigger = nodes.listen(self.catalog.ticks, "price", symbol) if poll_ms is None else nodes.interval(self.catalog.of(symbol), poll_ms)
        return nodes.access(trigger, self.catalog.store(symbol, name), symbol)
