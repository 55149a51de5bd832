"""Row-at-a-time oracles, written from the semantics alone."""

import datetime as dt
import math

T0 = dt.datetime(2024, 1, 1)


def ticks(spark, rows, schema="symbol string, seq long, ts timestamp_ntz, price double, volume double"):
    """rows: (symbol, price, volume) one second apart."""
    return spark.createDataFrame([(s, i, T0 + dt.timedelta(seconds=i), p, q) for i, (s, p, q) in enumerate(rows)], schema)


def stream(spark, rows):
    """rows: (symbol, value) one second apart, as a stream of values."""
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=i), i, 0, float(v)) for i, (s, v) in enumerate(rows)], "symbol string, ts timestamp_ntz, seq long, pos int, value double")


def median(v):
    v, n = sorted(v), len(v)
    return (v[n // 2] + v[(n - 1) // 2]) / 2


def mean(v):
    return sum(v) / len(v)


def variance(v):
    return sum((x - mean(v)) ** 2 for x in v) / len(v)


def folded(v, k):
    acc = v[0]
    for x in v[1:]:
        acc = k * x + (1 - k) * acc
    return acc


def two(f):
    return lambda v: f(v) if len(v) >= 2 else 0.0


def power(a, b):
    try:
        return math.pow(a, b)
    except (ValueError, ZeroDivisionError, OverflowError):
        return math.inf if a == 0 else math.nan


EPS = 1e-6
ORACLE = {
    "mean": mean, "avg": mean, "sum": sum, "product": math.prod, "min": min, "max": max, "last": lambda v: v[-1], "first": lambda v: v[0], "count": len, "median": median,
    "range": two(lambda v: max(v) - min(v)), "spread": two(lambda v: max(v) - min(v)), "stddev": two(lambda v: math.sqrt(variance(v))), "variance": two(variance), "diff": two(lambda v: v[-1] - v[0]),
    "div": two(lambda v: v[0] / v[-1] if abs(v[-1]) > EPS else 0.0), "ratio": two(lambda v: v[0] / v[-1] if abs(v[-1]) > EPS else 0.0), "mod": two(lambda v: math.fmod(v[0], v[-1]) if abs(v[-1]) > EPS else 0.0),
    "pow": two(lambda v: power(v[0], v[-1])), "midpoint": lambda v: (v[0] + v[-1]) / 2, "pct_change": two(lambda v: 100 * (v[-1] - v[0]) / v[0] if abs(v[0]) > EPS else 0.0),
    "abs": lambda v: abs(v[-1]), "neg": lambda v: -v[-1], "reciprocal": lambda v: 1 / v[-1] if abs(v[-1]) > EPS else 0.0, "sqrt": lambda v: math.sqrt(abs(v[-1])), "cbrt": lambda v: math.cbrt(v[-1]), "exp": lambda v: math.exp(v[-1]),
    "log": lambda v: math.log(v[-1]) if v[-1] > 0 else 0.0, "log2": lambda v: math.log2(v[-1]) if v[-1] > 0 else 0.0, "log10": lambda v: math.log10(v[-1]) if v[-1] > 0 else 0.0,
    "ceil": lambda v: math.ceil(v[-1]), "floor": lambda v: math.floor(v[-1]), "round": lambda v: math.copysign(math.floor(abs(v[-1]) + 0.5), v[-1]), "trunc": lambda v: math.trunc(v[-1]), "sign": lambda v: (v[-1] > 0) - (v[-1] < 0),
    "sin": lambda v: math.sin(v[-1]), "cos": lambda v: math.cos(v[-1]), "tan": lambda v: math.tan(v[-1]), "asin": lambda v: math.asin(max(-1, min(1, v[-1]))), "acos": lambda v: math.acos(max(-1, min(1, v[-1]))), "atan": lambda v: math.atan(v[-1]),
    "atan2": two(lambda v: math.atan2(v[0], v[-1])), "gt": two(lambda v: v[0] > v[-1]), "lt": two(lambda v: v[0] < v[-1]), "gte": two(lambda v: v[0] >= v[-1]), "lte": two(lambda v: v[0] <= v[-1]),
    "eq": two(lambda v: abs(v[0] - v[-1]) < EPS), "neq": two(lambda v: abs(v[0] - v[-1]) >= EPS), "and": lambda v: all(x > 0.5 for x in v), "or": lambda v: any(x > 0.5 for x in v), "not": lambda v: v[-1] <= 0.5,
    "zscore": lambda v: (v[-1] - mean(v)) / math.sqrt(variance(v)) if len(v) >= 3 and math.sqrt(variance(v)) > EPS else 0.0, "ema_weight": lambda v: folded(v, 2 / (len(v) + 1)),
    "cumulative_return": two(lambda v: (v[-1] - v[0]) / v[0] if abs(v[0]) > EPS else 0.0),
}


def same(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is b
    a, b = float(a), float(b)
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
