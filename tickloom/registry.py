"""Extension points: functions, node types, event computers, providers, sources, settings, event types, connectors."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tickloom.config import Config, load
from tickloom.functions import FunctionRegistry
from tickloom.plans.compile import Builder, Catalog, Compiler, Provider

Computer = Callable[[DataFrame], DataFrame]
Source = Callable[[SparkSession, dict], DataFrame]


@dataclass(frozen=True)
class EventType:
    name: str
    fields: T.StructType
    dispatchable: bool = True


class Connector(Protocol):
    def register_with(self, engine: Engine) -> None: ...
    def start(self) -> None: ...
    def stop(self) -> None: ...


def _new(table: dict, name: str, value, what: str) -> None:
    if not name:
        raise ValueError(f"a {what} needs a name")
    if name in table:
        raise ValueError(f"{what} {name!r} is taken")
    table[name] = value


@dataclass
class Engine:
    """What is registered, and catalogs made of it. Functions may be replaced; all else may be registered once."""

    config: Config = field(default_factory=Config)
    functions: FunctionRegistry = field(default_factory=FunctionRegistry)
    builders: dict[str, Builder] = field(default_factory=dict)
    computers: dict[str, Callable[[Config], Computer]] = field(default_factory=dict)
    providers: dict[str, Provider] = field(default_factory=dict)
    sources: dict[str, Source] = field(default_factory=dict)
    settings: dict[str, Callable[[str, str], None]] = field(default_factory=dict)
    event_types: dict[str, EventType] = field(default_factory=dict)

    def register_node(self, kind: str, builder: Builder) -> None:
        _new(self.builders, kind, builder, "node type")

    def register_computer(self, event_type: str, factory: Callable[[Config], Computer]) -> None:
        _new(self.computers, event_type, factory, "computer")

    def register_provider(self, namespace: str, provider: Provider) -> None:
        _new(self.providers, namespace, provider, "provider")

    def register_source(self, kind: str, source: Source) -> None:
        _new(self.sources, kind, source, "source")

    def register_settings(self, prefix: str, reader: Callable[[str, str], None]) -> None:
        _new(self.settings, prefix, reader, "settings reader")

    def register_event_type(self, event_type: EventType) -> None:
        _new(self.event_types, event_type.name, event_type, "event type")

    def configure(self, text: str) -> Config:
        """Reads a settings file; keys that aren't the engine's own go to the reader of their prefix."""
        self.config = load(text, self.settings)
        return self.config

    def read(self, spark: SparkSession, kind: str, parameters: dict | None = None) -> DataFrame:
        if kind not in self.sources:
            raise KeyError(f"unknown source {kind!r}")
        return self.sources[kind](spark, parameters or {})

    def compute(self, events: DataFrame) -> dict[str, DataFrame]:
        """Each registered event type's computer on its own events."""
        return {kind: factory(self.config)(events.where(events["type"] == kind)) for kind, factory in self.computers.items()}

    def compiler(self, ticks: DataFrame) -> Compiler:
        return Compiler(Catalog(ticks, self.config, self.functions, self.providers, self.builders))

    @contextmanager
    def running(self, *connectors: Connector):
        """Registers and starts connectors in order, and stops those that started in reverse."""
        with ExitStack() as stack:
            for connector in connectors:
                connector.register_with(self)
            for connector in connectors:
                connector.start()
                stack.callback(connector.stop)
            yield self
