"""What reducers are written in: quantities of an ordered vector, over a frame, an array or a group."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickloom.schema import ORDER


class Basis:
    """first, last, n, total, mean, product, low, high, middle, deviation, variance of a vector of doubles, power, weighted, and an ordered fold over it.

    power is the first value to the power of the last. weighted is the exponential mean of the whole vector with a weight of 2 / (n + 1), from its first value on.
    """

    first: Column
    last: Column
    n: Column
    total: Column
    mean: Column
    product: Column
    low: Column
    high: Column
    middle: Column
    deviation: Column
    variance: Column
    vector: Column

    @property
    def power(self) -> Column:
        return F.pow(self.first, self.last)

    @property
    def weighted(self) -> Column:
        k = F.lit(2.0) / (self.n + 1)
        return F.aggregate(F.slice(self.vector, 2, F.greatest(F.size(self.vector) - 1, F.lit(0))), self.first, lambda acc, x: k * x + (1 - k) * acc)

    def several(self, least: int, value: Column, also: Column | None = None) -> Column:
        """value of vectors of at least that size, if also holds, else 0."""
        condition = self.n >= least
        return F.when(condition if also is None else condition & also, value).otherwise(F.lit(0.0))


QUANTITIES = ("first", "n", "total", "mean", "product", "low", "high", "middle", "deviation", "variance", "power", "weighted")


class NotedBasis(Basis):
    """Notes which quantities an expression is made of."""

    def __init__(self):
        self.used: set[str] = set()

    def __getattribute__(self, name: str):
        if name in QUANTITIES or name in ("last", "vector"):
            self.used.add(name)
            return F.array(F.lit(1.0)) if name == "vector" else F.lit(1) if name == "n" else F.lit(1.0)
        return super().__getattribute__(name)


class ColumnBasis(Basis):
    """Quantities that lie in columns of their own, as operators/rolling.py makes them."""

    def __init__(self, value: Column, names: tuple[str, ...]):
        self.last, self.names = value, names

    def __getattribute__(self, name: str):
        if name in QUANTITIES and name in super().__getattribute__("names"):
            return F.col(f"__{name}").cast("long") if name == "n" else F.col(f"__{name}")
        return super().__getattribute__(name)


class FrameBasis(Basis):
    """The last `rows` values of a symbol, at each row, as window expressions: one specification for all, so one sort. For functions of the vector itself."""

    def __init__(self, value: Column, rows: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ORDER):
        self.value = self.last = value
        self.over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)

    first = cached_property(lambda self: F.first(self.value).over(self.over))
    n = cached_property(lambda self: F.count(F.lit(1)).over(self.over))
    total = cached_property(lambda self: F.sum(self.value).over(self.over))
    mean = cached_property(lambda self: F.avg(self.value).over(self.over))
    product = cached_property(lambda self: F.product(self.value).over(self.over))
    low = cached_property(lambda self: F.min(self.value).over(self.over))
    high = cached_property(lambda self: F.max(self.value).over(self.over))
    middle = cached_property(lambda self: F.percentile(self.value, 0.5).over(self.over))
    deviation = cached_property(lambda self: F.stddev_pop(self.value).over(self.over))
    variance = cached_property(lambda self: F.var_pop(self.value).over(self.over))
    vector = cached_property(lambda self: F.collect_list(self.value).over(self.over))


class GroupBasis(Basis):
    """A group's values in order, as aggregates that are combined before the shuffle."""

    def __init__(self, value: Column, order: tuple[str, ...] = ORDER):
        at = F.struct(*order)
        self.first, self.last = F.min_by(value, at), F.max_by(value, at)
        self.n, self.total, self.mean = F.count(value), F.sum(value), F.avg(value)
        self.product, self.low, self.high = F.product(value), F.min(value), F.max(value)
        self.middle, self.deviation, self.variance = F.percentile(value, 0.5), F.stddev_pop(value), F.var_pop(value)
        self.vector = F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("value")))), lambda x: x["value"])


class ArrayBasis(Basis):
    """An array column; an empty one gives 0 for each quantity."""

    def __init__(self, vector: Column):
        zero = F.lit(0.0)
        filled = F.when(F.size(vector) > 0, vector).otherwise(F.array(zero))
        self.vector, self.n = vector, F.size(vector)
        self.first, self.last = F.element_at(filled, 1), F.element_at(filled, -1)
        self.total = F.aggregate(vector, zero, lambda acc, x: acc + x)
        size = F.greatest(self.n, F.lit(1)).cast("double")
        self.mean = self.total / size
        self.product = F.when(self.n > 0, F.aggregate(vector, F.lit(1.0), lambda acc, x: acc * x)).otherwise(zero)
        self.low, self.high = F.array_min(filled), F.array_max(filled)
        ordered, half = F.array_sort(filled), F.size(filled)
        self.middle = (F.element_at(ordered, ((half + 1) / 2).cast("int")) + F.element_at(ordered, (half / 2).cast("int") + 1)) / 2
        mean = self.mean
        self.variance = F.aggregate(F.transform(vector, lambda x: (x - mean) * (x - mean)), zero, lambda acc, x: acc + x) / size
        self.deviation = F.sqrt(self.variance)
