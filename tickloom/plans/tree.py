"""Request trees: JSON to typed nodes, with the limits that a request must keep."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from tickloom.functions import FUNCTIONS, FunctionRegistry
from tickloom.functions.builtin import STRUCTURAL

#: Limits of a request: nesting, members of an array, characters of a string, of a stream key and of a field.
MAX_DEPTH, MAX_ITEMS, MAX_STRING, MAX_KEY, MAX_FIELD = 32, 64, 4096, 64, 128
MAX_PERIOD = 3_600_000


class RequestError(ValueError):
    """where: validate or build, as an error frame says it."""

    def __init__(self, where: str, message: str):
        super().__init__(message)
        self.where = where


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Listener(Node):
    field: str
    symbol: str | None = None


@dataclass(frozen=True)
class Worker(Node):
    fn: str
    parameters: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Aggregate(Node):
    arity: int
    inputs: tuple[Node, ...]


@dataclass(frozen=True)
class Accessor(Node):
    """each: reads under the symbol of every value, as below a split by symbol."""

    field: str
    symbol: str | None = None
    each: bool = False


@dataclass(frozen=True)
class Timer(Node):
    """aligned: at multiples of the period."""

    period_ms: int
    aligned: bool
    child: Node | None = None


@dataclass(frozen=True)
class Tumbling(Node):
    period_ms: int


@dataclass(frozen=True)
class Vector(Node):
    fn: str


@dataclass(frozen=True)
class Fused(Node):
    """Tumbling and Vector as one grouped aggregate."""

    period_ms: int
    fn: str


@dataclass(frozen=True)
class Split(Node):
    child: Node


@dataclass(frozen=True)
class Chain(Node):
    stages: tuple[Node, ...]


@dataclass(frozen=True)
class Custom(Node):
    kind: str
    spec: str  # its JSON


@dataclass(frozen=True)
class Request:
    key: int | str
    symbol: str
    field: str
    pipeline: tuple[Node, ...] = ()
    node: Node | None = None
    warnings: tuple[str, ...] = field(default=(), compare=False)


def check_json(value, depth: int = 0) -> None:
    """Depth, array and string limits, over every member."""
    if depth > MAX_DEPTH:
        raise RequestError("validate", "nested too deeply")
    if isinstance(value, dict):
        for k, v in value.items():
            check_json(k, depth)
            check_json(v, depth + 1)
    elif isinstance(value, list):
        if len(value) > MAX_ITEMS:
            raise RequestError("validate", "array too long")
        for v in value:
            check_json(v, depth + 1)
    elif isinstance(value, str) and len(value) > MAX_STRING:
        raise RequestError("validate", "string too long")


def check_document(document: dict) -> None:
    """A document of an id and a tree; an empty tree will do."""
    if not isinstance(document, dict) or not isinstance(document.get("id"), str) or not 1 <= len(document["id"]) <= MAX_STRING:
        raise RequestError("validate", "id must be a string of 1 to 4096 characters")
    if not isinstance(document.get("tree"), dict):
        raise RequestError("validate", "tree must be an object")
    check_json(document["tree"])


def _text(spec: dict, name: str, most: int, default: str | None = None) -> str:
    value = spec.get(name, default)
    if not isinstance(value, str) or not 1 <= len(value) <= most:
        raise RequestError("build", f"{name} must be a string of 1 to {most} characters")
    return value


def _period(spec: dict) -> int:
    value = spec.get("periodMs", spec.get("ms"))
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= MAX_PERIOD:
        raise RequestError("build", f"{spec['type']} needs a period of 1 to {MAX_PERIOD} ms")
    return value


class Parser:
    """Nodes from JSON; node types may be added, built-in ones can't be replaced."""

    def __init__(self, functions: FunctionRegistry = FUNCTIONS):
        self.functions = functions
        self.custom: set[str] = set()

    KINDS = ("Listener", "Worker", "Aggregate", "AtomicAccessor", "Interval", "BucketTime", "TumblingWindow", "VectorReducer", "GroupSplit", "SymbolSplit", "Chain")

    def register(self, kind: str) -> None:
        if kind in self.custom or kind in self.KINDS:
            raise RequestError("build", f"node type {kind!r} is taken")
        self.custom.add(kind)

    def _function(self, spec: dict, plain_only: bool) -> str:
        fn = spec.get("fn")
        if not isinstance(fn, str) or fn not in self.functions or (plain_only and fn not in self.functions.plain):
            raise RequestError("build", f"unknown function {fn!r}")
        return fn

    def node(self, spec, symbol: str | None, each: bool = False) -> Node:
        """symbol: the stream key that nodes without one of their own take; with each it is that of the value that arrives."""
        if not isinstance(spec, dict) or not isinstance(spec.get("type"), str):
            raise RequestError("build", "a node must be an object with a type")
        kind = spec["type"]
        own = spec.get("streamKey", spec.get("symbol", symbol))
        if kind == "Listener":
            name = _text(spec, "field", MAX_FIELD)
            if name.startswith("ob."):
                raise RequestError("build", "ob. keys are read by AtomicAccessor, not listened to")
            return Listener(name, own)
        if kind == "Worker":
            fn = self._function(spec, plain_only=False)
            numbers = tuple(sorted((k, float(v)) for k, v in spec.items() if k not in STRUCTURAL and isinstance(v, (int, float)) and not isinstance(v, bool)))
            return Worker(fn, numbers)
        if kind == "Aggregate":
            arity, inputs = spec.get("arity"), spec.get("inputs")
            if isinstance(arity, bool) or not isinstance(arity, int) or arity < 1:
                raise RequestError("build", "arity must be a positive integer")
            if not isinstance(inputs, list) or not inputs:
                raise RequestError("build", "Aggregate needs inputs")
            return Aggregate(arity, tuple(self.node(x, symbol, each) for x in inputs))
        if kind == "AtomicAccessor":
            return Accessor(_text(spec, "field", MAX_FIELD), own, each and own is None)
        if kind in ("Interval", "BucketTime"):
            child = spec.get("child")
            return Timer(_period(spec), kind == "BucketTime", None if child is None else self.node(child, symbol, each))
        if kind == "TumblingWindow":
            return Tumbling(_period(spec))
        if kind == "VectorReducer":
            return Vector(self._function(spec, plain_only=True))
        if kind in ("GroupSplit", "SymbolSplit"):
            return Split(self.node(spec.get("child"), None, True))
        if kind == "Chain":
            stages = spec.get("stages")
            if not isinstance(stages, list) or not stages:
                raise RequestError("build", "Chain needs stages")
            return Chain(tuple(self.node(x, symbol, each) for x in stages))
        if kind in self.custom:
            return Custom(kind, json.dumps(spec, sort_keys=True))
        raise RequestError("build", f"unknown node type {kind!r}")

    def request(self, spec: dict | str) -> Request:
        """A subscribe request: streamKey (or symbol), field, and a node, a pipeline or stages; of the last two, pipeline wins."""
        if isinstance(spec, str):
            try:
                spec = json.loads(spec)
            except ValueError:
                raise RequestError("validate", "a request must be JSON") from None
        if not isinstance(spec, dict):
            raise RequestError("validate", "a request must be an object")
        check_json(spec)
        key = spec.get("key", spec.get("id", spec.get("requestId", 0)))
        if isinstance(key, bool) or not isinstance(key, (int, str)):
            raise RequestError("validate", "key must be an integer or a string")
        symbol = spec.get("streamKey", spec.get("symbol"))
        for name, value, most in (("streamKey", symbol, MAX_KEY), ("field", spec.get("field"), MAX_FIELD)):
            if not isinstance(value, str) or not 1 <= len(value) <= most:
                raise RequestError("validate", f"{name} must be a string of 1 to {most} characters")
        stages = spec.get("pipeline", spec.get("stages", []))
        if not isinstance(stages, list):
            raise RequestError("build", "a pipeline must be an array")
        pipeline = tuple(self.node(x, symbol) for x in stages)
        node = None if spec.get("node") is None else self.node(spec["node"], symbol)
        warnings = tuple(f"Aggregate of arity {n.arity} with {len(n.inputs)} inputs" for n in (*pipeline, node) if isinstance(n, Aggregate) and n.arity != len(n.inputs))
        return Request(key, symbol, spec["field"], pipeline, node, warnings)
