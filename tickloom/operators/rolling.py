"""Running functions of bounded frames in linear time: one pass over each symbol's rows in order, block by block.

A symbol's rows are cut into blocks with halos (operators/blocks.py), so that a hot symbol spreads over tasks. In a task a
block's rows stream through in Arrow batches; beside a batch only the last rows that its frames reach are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.operators.blocks import with_blocks
from tickloom.schema import ORDER

#: From the columns' values up to each place, how many of them belong to earlier batches, and the rows of the block up to each place,
#: to (values, where they are known or None for everywhere) of each output.
Compute = Callable[[dict[str, np.ndarray], int, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray | None]]]


def ewm(x: np.ndarray, k: float) -> np.ndarray:
    """The recurrence y = (1 - k) y + k x from the first value on."""
    return pd.Series(x).ewm(alpha=k, adjust=False).mean().to_numpy()


def sliding_ema(x: np.ndarray, k: float, rows: int) -> np.ndarray:
    """The exponential mean of the last `rows` values, from the oldest of them on.

    With E the mean from the first value on, the one from place lo on is E_i + (1 - k)^(i - lo) (x_lo - E_lo): linear time.
    """
    full = ewm(x, k)
    if len(x) > rows:
        full = full.copy()
        gap = x - full
        full[rows - 1 :] += (1.0 - k) ** (rows - 1) * gap[: len(x) - rows + 1]
    return full


class Slide:
    """Quantities of the last `rows` values at each place of x, whose block holds `seen` rows up to there; start: places before it don't matter."""

    def __init__(self, x: np.ndarray, rows: int, seen: np.ndarray, start: int = 0):
        self.x, self.rows, self.start, self.n = x, rows, start, np.minimum(seen, rows)
        finite = np.isfinite(x)
        self.odd = None if finite.all() else pd.Series(~finite).rolling(rows, min_periods=1).max().to_numpy() > 0
        self.roll = pd.Series(x if self.odd is None else np.where(finite, x, 0.0)).rolling(rows, min_periods=1)

    def _exact(self, values: np.ndarray, f: Callable[[np.ndarray], float]) -> np.ndarray:
        """values, but computed one by one where a frame holds what isn't a finite number."""
        if self.odd is not None:
            values = values.copy()
            for i in np.flatnonzero(self.odd[self.start :]) + self.start:
                with np.errstate(all="ignore"):
                    values[i] = f(self.x[max(0, i - self.rows + 1) : i + 1])
        return values

    first = cached_property(lambda self: self.x[np.maximum(np.arange(len(self.x)) - self.rows + 1, 0)])
    total = cached_property(lambda self: self._exact(self.roll.sum().to_numpy(), np.sum))
    mean = cached_property(lambda self: self._exact(self.roll.mean().to_numpy(), np.mean))
    low = cached_property(lambda self: self._exact(self.roll.min().to_numpy(), np.fmin.reduce))
    high = cached_property(lambda self: self._exact(self.roll.max().to_numpy(), np.max))
    middle = cached_property(lambda self: self._exact(self.roll.median().to_numpy(), lambda v: float(np.mean(np.sort(v)[[(len(v) - 1) // 2, len(v) // 2]]))))
    variance = cached_property(lambda self: self._exact(np.maximum(self.roll.var(ddof=0).to_numpy(), 0.0), np.var))
    deviation = cached_property(lambda self: np.sqrt(self.variance))
    #: By the C library's pow, whose last bit isn't always that of Java's.
    power = cached_property(lambda self: pc.power(pa.array(self.first), pa.array(self.x)).to_numpy())

    @cached_property
    def product(self) -> np.ndarray:
        """A frame is the end of one run of `rows` values and the beginning of the next, so two running products make it; they are held wide enough not to overflow before it does."""
        n, rows = len(self.x), self.rows
        runs = np.concatenate([self.x, np.ones(-n % rows)]).astype(np.longdouble).reshape(-1, rows)
        with np.errstate(all="ignore"):
            before = np.multiply.accumulate(runs, axis=1).ravel()[:n]
            after = np.multiply.accumulate(runs[:, ::-1], axis=1)[:, ::-1].ravel()
            out = before.copy()
            at = np.arange(rows - 1, n)
            at = at[(at + 1) % rows != 0]
            out[at] = after[at - rows + 1] * before[at]
            return self._exact(out.astype(np.float64), np.prod)

    @cached_property
    def weighted(self) -> np.ndarray:
        """The exponential mean of the whole frame with a weight of 2 / (n + 1)."""
        out = sliding_ema(np.where(np.isfinite(self.x), self.x, 0.0), 2.0 / (self.rows + 1), self.rows)
        for i in np.flatnonzero(self.n[self.start :] < self.rows) + self.start:  # a symbol's first rows, each with a weight of its own
            k = 2.0 / (i + 2)
            powers = (1.0 - k) ** np.arange(i, -1, -1)
            powers[1:] *= k
            out[i] = powers @ self.x[: i + 1]
        return self._exact(out, lambda v: ewm(v, 2.0 / (len(v) + 1))[-1])


def quantities(names: tuple[str, ...], rows: int) -> Compute:
    """Of the column value the named quantities of a frame."""

    def compute(own: dict[str, np.ndarray], start: int, seen: np.ndarray) -> dict:
        slide = Slide(own["value"], rows, seen, start)
        return {f"__{n}": (np.asarray(getattr(slide, n), np.float64), None) for n in names}

    return compute


def running(df: DataFrame, columns: tuple[str, ...], compute: Compute, outputs: tuple[str, ...], reach: int, target: int = 200_000, bucket_seconds: int = 3600, key: str = "symbol") -> DataFrame:
    """df (key, ts, seq, pos and more, with numeric columns) with outputs, doubles that compute() makes of the last `reach` rows of a key and the row itself.

    Nulls among the columns are NaN for compute(). One shuffle by block and one sort; memory follows a batch and the reach.
    """
    names = df.columns
    dealt = with_blocks(df, reach, target, bucket_seconds, key).select(*names, "block", "halo").repartition(key, "block").sortWithinPartitions(key, "block", *ORDER)
    places = {c: names.index(c) for c in (key, *columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tail, count = None, {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, block = batch.column(places[key]), batch.column(len(names)).to_numpy()
            code = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy()
            values = {c: pc.fill_null(batch.column(places[c]).cast(pa.float64()), float("nan")).to_numpy() for c in columns}
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
            made: dict[str, list[np.ndarray]] = {o: [] for o in outputs}
            known: dict[str, list[np.ndarray]] = {o: [] for o in outputs}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = (keys[a].as_py(), int(block[a]))
                if now != held:
                    held, tail, count = now, {c: np.zeros(0) for c in columns}, 0
                own = {c: np.concatenate([tail[c], values[c][a:b]]) for c in columns}
                start = len(tail[columns[0]])
                got = compute(own, start, count - start + 1 + np.arange(start + b - a))
                for o in outputs:
                    made[o].append(got[o][0][start:])
                    known[o].append(np.ones(b - a, bool) if got[o][1] is None else got[o][1][start:])
                tail, count = {c: x[-reach:] for c, x in own.items()}, count + b - a
            keep = pc.invert(batch.column(len(names) + 1))
            arrays = [batch.column(i) for i in range(len(names))]
            arrays += [pa.array(np.concatenate(made[o]), pa.float64(), mask=~np.concatenate(known[o])) for o in outputs]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *outputs]).filter(keep)

    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(o, T.DoubleType()) for o in outputs)]))
