"""A client's session: subscribe, cancel, and frames, without a network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import nodes
from tickloom.plans.compile import Compiler
from tickloom.plans.tree import Request, RequestError
from tickloom.streaming.requests import live


class Bucket:
    """Tokens for subscribe messages: a burst, refilled at a rate."""

    def __init__(self, burst: int = 20, rate: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.burst, self.rate, self.clock = burst, rate, clock
        self.tokens, self.at = float(burst), clock()

    def take(self) -> bool:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


class Session:
    """Requests of one client over a compiler's catalog; batch plans by key, and streaming queries that cancel() stops."""

    LIMIT = 256

    def __init__(self, compiler: Compiler, bucket: Bucket | None = None):
        self.compiler, self.bucket = compiler, bucket or Bucket()
        self.active: dict[int | str, DataFrame] = {}
        self.queries: dict[int | str, StreamingQuery] = {}
        self.requests: dict[int | str, Request] = {}

    @staticmethod
    def _named(key: int | str) -> dict:
        return {"key": key} if isinstance(key, int) else {"requestId": key}

    def handle(self, text: str) -> list[dict]:
        """Answers to a message: subscribed, canceled and error frames."""
        try:
            message = json.loads(text)
        except ValueError:
            return [{"type": "error", "where": "parse", "message": "not JSON"}]
        kind = message.get("type") if isinstance(message, dict) else None
        if kind == "subscribe":
            return self.subscribe(message.get("requests"))
        if kind == "cancel":
            named = [message.get(k) or [] for k in ("keys", "ids")]
            if not all(isinstance(x, list) and all(isinstance(k, (int, str)) for k in x) for x in named):
                return [{"type": "error", "where": "cancel", "message": "keys and ids must be arrays of integers or strings"}]
            return self.cancel([*named[0], *named[1]])
        return [{"type": "error", "where": "type", "message": f"unknown type {kind!r}"}]

    def subscribe(self, requests) -> list[dict]:
        if not self.bucket.take():
            return [{"type": "error", "where": "rate", "message": "too many subscribe messages"}]
        if not isinstance(requests, list):
            return [{"type": "error", "where": "subscribe", "message": "requests must be an array"}]
        out = []
        for spec in requests:
            try:
                request = self.compiler.parser.request(spec)
                if len(self.active) >= self.LIMIT and request.key not in self.active:
                    raise RequestError("limit", "too many subscriptions")
                self.requests[request.key] = request
                self.active[request.key] = nodes.respond(self.compiler.stream(request), request.key)
                out.append({"type": "subscribed", **self._named(request.key)})
            except RequestError as e:
                out.append({"type": "error", "where": e.where, "message": str(e)})
            except KeyError as e:
                out.append({"type": "error", "where": "build", "message": str(e)})
        return out

    def cancel(self, keys: list) -> list[dict]:
        """Ends requests, and whatever runs for them."""
        out = []
        for key in keys:
            if self.active.pop(key, None) is None:
                out.append({"type": "error", "where": "cancel", "message": f"no request {key!r}"})
                continue
            running = self.queries.pop(key, None)
            if running is not None:
                running.stop()
            out.append({"type": "canceled", **self._named(key)})
        return out

    def updates(self, key: int | str) -> DataFrame:
        """A request's update frames, as a batch."""
        return nodes.frames(self.active[key])

    def live(self, key: int | str, ticks: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], delay: str = "0 seconds") -> StreamingQuery:
        """Runs a request on a stream of ticks, its update frames into a sink; cancel() stops it."""
        return self.start(key, nodes.frames(live(self.compiler, self.requests[key], ticks, delay)), checkpoint, sink)

    def start(self, key: int | str, stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
        """Runs a stream for a request into a sink of micro-batches; cancel() stops it."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
        self.queries[key] = query
        return query

    def close(self) -> None:
        self.cancel(list(self.active))
