"""Requests on unbounded streams of ticks: the same trees as in batch, as stateful or windowed queries.

Functions of the last value are expressions; a running function keeps each symbol's last values as its state and is computed by
the same linear pass as in batch; a tumbling window and its reducer are an event-time aggregate. A request may hold one of the
latter two, which is what one streaming query can keep state for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import ColumnBasis, NotedBasis
from tickloom.functions.builtin import Reducer
from tickloom.operators import nodes
from tickloom.operators.rolling import quantities
from tickloom.plans.compile import Compiler
from tickloom.plans.rewrite import rewrite
from tickloom.plans.tree import Fused, Request, RequestError, Worker
from tickloom.streaming import state, windows


def work(stream: DataFrame, reducer: Reducer, rows: int = 1000) -> DataFrame:
    """(symbol, ts, seq, value): a running reduction over the last `rows` values of each symbol, at every input."""
    noted = NotedBasis()
    reducer(noted)
    if "vector" in noted.used:
        raise RequestError("build", "a function of the whole vector can't run on a stream")
    names = tuple(sorted(noted.used - {"last"}))
    own = stream.select("symbol", "ts", "seq", F.col("value").cast("double").alias("value")).where("value is not null")
    if names:
        compute, outputs = quantities(names, rows), [f"__{n}" for n in names]

        def step(held: dict, group: pd.DataFrame) -> pd.DataFrame:
            tail = held.get("tail", np.zeros(0))
            values = np.concatenate([tail, group["value"].to_numpy(np.float64)])
            seen = held.get("count", 0) - len(tail) + 1 + np.arange(len(values))
            got = compute({"value": values}, len(tail), seen)
            held["tail"], held["count"] = values[-rows:], held.get("count", 0) + len(group)
            out = group[["symbol", "ts", "seq", "value"]].copy()
            for o in outputs:
                out[o] = got[o][0][len(tail) :]
            return out

        own = state.keyed(own, step, "symbol string, ts timestamp, seq long, value double" + "".join(f", {o} double" for o in outputs))
    return own.select("symbol", "ts", "seq", reducer(ColumnBasis(F.col("value"), names)).alias("value")).where("value is not null")


def live(compiler: Compiler, request: Request | dict | str, ticks: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(key, requestId, symbol, ts, value) of a request over a stream of the catalog's tick rows; delay: how late rows of a window may be."""
    request = request if isinstance(request, Request) else compiler.parser.request(request)
    catalog = compiler.catalog
    name = catalog.fields.get(request.field, request.field)
    if name not in ticks.columns:
        raise RequestError("build", f"unknown field {request.field!r}")
    if request.node is not None and request.pipeline:
        raise RequestError("build", "a node beside a pipeline is two streams")
    out = ticks.where(F.col("symbol") == request.symbol).select("symbol", "ts", "seq", F.col(name).alias("value")).where("value is not null")
    stateful = False
    for node in rewrite((request.node,) if request.node is not None else request.pipeline):
        noted = NotedBasis()
        if isinstance(node, Worker):
            reducer = catalog.functions.resolve(node.fn, dict(node.parameters))
            reducer(noted)
            keeps = bool(noted.used - {"last"})
            if stateful and keeps:
                raise RequestError("build", "a stream keeps state for one function or window")
            out = work(out, reducer, catalog.config.history)
            stateful |= keeps
        elif isinstance(node, Fused) and not stateful:
            out = windows.tumble_reduce(out, node.period_ms, {"value": catalog.functions.resolve(node.fn, plain_only=True)}, delay).withColumn("seq", F.lit(0).cast("long"))
            stateful = True
        else:
            raise RequestError("build", f"{type(node).__name__} can't run on a stream here")
    return nodes.respond(out, request.key)
