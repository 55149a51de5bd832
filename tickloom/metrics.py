"""Counters and gauges of what runs: observed row counts of batches, progress of streams."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Metrics:
    """Named counters, which add up, and gauges, which hold the last value."""

    def __init__(self):
        self._lock, self._counts, self._gauges = threading.Lock(), defaultdict(float), {}
        self._observed: list[tuple[str, Observation]] = []

    def count(self, name: str, by: float = 1.0) -> None:
        with self._lock:
            self._counts[name] += by

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self._gauges[name] = value

    def observe(self, df: DataFrame, name: str) -> DataFrame:
        """df, whose rows are counted as it runs, without another pass."""
        watch = Observation(name)
        self._observed.append((name, watch))
        return df.observe(watch, F.count(F.lit(1)).alias("rows"))

    def collect(self) -> dict[str, float]:
        """All values so far; observed plans must have run."""
        for name, watch in self._observed:
            self.count(f"{name}.rows", watch.get["rows"])
        self._observed.clear()
        with self._lock:
            return {**self._counts, **self._gauges}


class Progress(StreamingQueryListener):
    """Puts each stream's progress into metrics."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.count("streams.started")

    def onQueryProgress(self, event) -> None:
        own = event.progress
        self.metrics.count(f"stream.{own.name or own.id}.rows", own.numInputRows)
        self.metrics.gauge(f"stream.{own.name or own.id}.rows_per_sec", own.processedRowsPerSecond or 0.0)

    def onQueryTerminated(self, event) -> None:
        self.metrics.count("streams.ended")
