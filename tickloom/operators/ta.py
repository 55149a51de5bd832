"""Technical indicators per tick over a symbol's bounded history, and the incremental ones.

Ticks are (symbol, ts, seq, price, volume). All indicators of a tick come from one pass over blocks of its symbol's rows, in
linear time. Indicators that aren't there yet are null; strict_nan gives NaN where the value is written
before it is defined, and 0 for MACD's signal and histogram during warm-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Config
from tickloom.functions import EPSILON
from tickloom.operators.rolling import Compute, Slide, ewm, running, sliding_ema
from tickloom.schema import ORDER

LIGHT = ("lastPrice", "volume", "openPrice", "highPrice", "lowPrice")


def _columns() -> tuple[Column, Column]:
    """Price and volume; not at import, since workers import this module too."""
    return F.col("price"), F.col("volume")


def _positions(ticks: DataFrame) -> DataFrame:
    return ticks if "pos" in ticks.columns else ticks.withColumn("pos", F.lit(0))


def _ratio(a: Column, b: Column, condition: Column) -> Column:
    return a / F.when(condition, b)


def names_of(config: Config) -> tuple[str, ...]:
    """Indicators that look back on rows, but for the exponential ones."""
    return (
        "lastPrice", "openPrice", "highPrice", "lowPrice", "mean", "median", "prevClose", "vwap", *(f"sma_{k}" for k in config.sma), f"rsi_{config.rsi}", "bollinger_upper", "bollinger_lower", "bollinger_middle",
        f"momentum_{config.momentum}", f"roc_{config.momentum}", f"atr_{config.atr}", "volume", f"volume_avg_{config.volume_avg}", "obv", "volatility_rank",
    )


def exponential_names(config: Config) -> tuple[str, ...]:
    return (*(f"ema_{n}" for n in config.ema), "macd_line", "macd_signal", "macd_histogram")


def _compute(config: Config, names: tuple[str, ...]) -> Compute:
    """The named indicators, each an array over a run of rows and where it is known."""
    band, history = config.bollinger, config.history

    def last(x: np.ndarray, k: int):
        return pd.Series(x).rolling(k, min_periods=1)

    def run(own: dict[str, np.ndarray], start: int, seen: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
        price, volume = own["price"], own["volume"]
        slide, n = Slide(price, history, seen, start), np.minimum(seen, history)
        change = np.diff(price, prepend=np.nan)
        before = lambda k: np.concatenate([np.full(min(k, len(price)), np.nan), price[: max(len(price) - k, 0)]])
        mean = lambda x, k: last(x, k).mean().to_numpy()
        deviation = lambda: np.sqrt(np.maximum(last(price, band).var(ddof=0).to_numpy(), 0.0))
        ema = lambda k: sliding_ema(price, 2.0 / (k + 1), history)

        def bollinger(width: float):
            return mean(price, band) + width * deviation(), n >= max(band, 2)

        def vwap():
            traded = last(volume, history).sum().to_numpy()
            some = (n >= 2) & (traded > 0) & (last(volume, history).max().to_numpy() > 0)
            return last(price * volume, history).sum().to_numpy() / np.where(some, traded, 1.0), some

        def rsi():
            gain, loss = (mean(np.where(np.isnan(change), np.nan, np.maximum(sign * change, 0.0)), config.rsi) for sign in (1, -1))
            return 100.0 - 100.0 / (1.0 + gain / np.maximum(loss, EPSILON)), n >= config.rsi + 1

        def roc():
            back = before(config.momentum)
            some = (n >= config.momentum + 1) & (np.abs(back) > EPSILON)
            return 100.0 * (price - back) / np.where(some, back, 1.0), some

        def rank():
            level = np.abs(slide.mean)
            some = (n >= max(band, 2)) & (level != 0)
            return np.minimum(deviation() / np.where(some, level, 1.0), 1.0), some

        def line():
            return ema(config.macd_fast) - ema(config.macd_slow), seen >= max(config.macd_slow, 2)

        def signal():
            """The exponential mean of the last values of the line, from the first of them on: a fixed weighted sum."""
            k, (value, some) = 2.0 / (config.macd_signal + 1), line()
            weights = [k * (1 - k) ** i for i in range(config.macd_signal - 1)] + [(1 - k) ** (config.macd_signal - 1)]
            value = pd.Series(np.where(some, value, np.nan))
            out = sum(w * value.shift(i) for i, w in enumerate(weights)).to_numpy()
            return out, ~np.isnan(out)

        def histogram():
            (value, _), (average, some) = line(), signal()
            return value - average, some

        made = {
            "lastPrice": lambda: (price, None),
            "openPrice": lambda: (slide.first, None),
            "highPrice": lambda: (slide.high, None),
            "lowPrice": lambda: (slide.low, None),
            "mean": lambda: (slide.mean, None),
            "median": lambda: (slide.middle, None),
            "prevClose": lambda: (before(1), seen >= 2),
            "vwap": vwap,
            **{f"sma_{k}": lambda k=k: (mean(price, k), n >= max(k, 2)) for k in config.sma},
            f"rsi_{config.rsi}": rsi,
            "bollinger_upper": lambda: bollinger(config.band_width),
            "bollinger_lower": lambda: bollinger(-config.band_width),
            "bollinger_middle": lambda: (mean(price, band), n >= max(band, 2)),
            f"momentum_{config.momentum}": lambda: (price - before(config.momentum), n >= config.momentum + 1),
            f"roc_{config.momentum}": roc,
            f"atr_{config.atr}": lambda: (mean(np.abs(change), config.atr), n >= config.atr + 1),
            "volume": lambda: (volume, None if names == LIGHT else n >= 2),
            f"volume_avg_{config.volume_avg}": lambda: (mean(volume, config.volume_avg), n >= max(config.volume_avg, 2)),
            # The oldest retained tick has no predecessor in the history, so it adds nothing.
            "obv": lambda: (last(np.sign(np.nan_to_num(change)) * volume, max(history - 1, 1)).sum().to_numpy(), n >= 2),
            "volatility_rank": rank,
            **{f"ema_{k}": lambda k=k: (ema(k), seen >= max(k, 2)) for k in config.ema},
            "macd_line": line,
            "macd_signal": signal,
            "macd_histogram": histogram,
        }
        with np.errstate(all="ignore"):
            return {name: made[name]() for name in names}

    return run


def indicators(ticks: DataFrame, config: Config, names: tuple[str, ...], target: int = 200_000, bucket_seconds: int = 3600) -> DataFrame:
    """(symbol, ts, seq, pos) and the named indicators of each tick with a price."""
    P, Q = _columns()
    rows = _positions(ticks).where("price is not null").select("symbol", *ORDER, P.cast("double").alias("price"), F.coalesce(Q.cast("double"), F.lit(0.0)).alias("volume") if "volume" in ticks.columns else F.lit(0.0).alias("volume"))
    inner = tuple(f"__{n}" for n in names)
    compute = _compute(config, names)

    def named(own: dict[str, np.ndarray], start: int, seen: np.ndarray) -> dict:
        return {f"__{k}": v for k, v in compute(own, start, seen).items()}

    found = running(rows, ("price", "volume"), named, inner, config.history + config.macd_signal + 1, target, bucket_seconds)
    return found.select("symbol", *ORDER, *(F.col(i).alias(n) for i, n in zip(inner, names, strict=True)))


def suite(ticks: DataFrame, config: Config = Config(), only: tuple[str, ...] | None = None) -> DataFrame:
    """(symbol, ts, seq, pos) and an indicator each: all but the exponential ones, or those named."""
    return indicators(ticks, config, tuple(n for n in names_of(config) if only is None or n in only))


def light(ticks: DataFrame, config: Config = Config()) -> DataFrame:
    """What is known per tick when indicators are off: last price, volume, and the history's open, high and low."""
    return indicators(ticks, config, LIGHT)


def exponential(ticks: DataFrame, config: Config = Config(), target: int = 200_000, bucket_seconds: int = 3600) -> DataFrame:
    """ema_N, macd_line, macd_signal and macd_histogram per tick."""
    return indicators(ticks, config, exponential_names(config), target, bucket_seconds)


def full_suite(ticks: DataFrame, config: Config = Config()) -> DataFrame:
    """Every indicator of a tick as a column, in one pass."""
    return indicators(ticks, config, (*names_of(config), *exponential_names(config))) if config.ta_enabled else light(ticks, config)


def strict_nan(indicators: DataFrame, config: Config = Config()) -> DataFrame:
    """Averages that aren't there yet as NaN from the second tick on, MACD's signal and histogram as 0 before its slow period."""
    order = Window.partitionBy("symbol").orderBy(*ORDER)
    n = F.row_number().over(order)
    out = indicators.withColumn("n", n)
    nan = F.lit(float("nan"))
    for c in out.columns:
        if c.startswith(("sma_", "ema_")) or c in ("macd_line", "vwap"):
            out = out.withColumn(c, F.when(F.col(c).isNull() & (F.col("n") >= 2), nan).otherwise(F.col(c)))
        elif c in ("macd_signal", "macd_histogram"):
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).when((F.col("n") >= 2) & (F.col("n") < config.macd_slow), 0.0).when(F.col("n") >= 2, nan))
    return out.drop("n")


def last_n(ticks: DataFrame, n: int) -> DataFrame:
    """Means, extremes, deviation, median and vwap of the last n ticks; null before there are so many."""
    P, Q = _columns()
    order = Window.partitionBy("symbol").orderBy(*ORDER)
    over = order.rowsBetween(-(n - 1), 0)
    rows = _positions(ticks).where("price is not null").withColumn("volume", F.coalesce(Q, F.lit(0.0)))
    full, traded = F.count(F.lit(1)).over(over) >= n, F.sum(Q).over(over)
    own = {"sma": F.avg(P), "min": F.min(P), "max": F.max(P), "stddev": F.stddev_pop(P), "median": F.percentile(P, 0.5)}
    return rows.select("symbol", *ORDER, *(F.when(full, c.over(over)).alias(f"px_{k}_{n}") for k, c in own.items()), F.when(full, _ratio(F.sum(P * Q).over(over), traded, traded > 0)).alias(f"px_vwap_{n}"))


def _by_symbol(ticks: DataFrame, names: list[str], step) -> DataFrame:
    """Unbounded recurrences: a symbol's rows stream through in order, a batch at once, with its state alone in memory."""
    rows = _positions(ticks).where("price is not null").select("symbol", *ORDER, "price")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.repartition("symbol").sortWithinPartitions("symbol", *ORDER)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        last = None
        for part in parts:
            out = []
            for symbol, own in part.groupby("symbol", sort=False):
                if symbol != last:
                    state, last = {}, symbol
                got = own[["symbol", *ORDER]].copy()
                for name, values in zip(names, step(own["price"].to_numpy(), state), strict=True):
                    got[name] = values
                out.append(got)
            if out:
                yield pd.concat(out)

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("symbol", *ORDER)) + ", " + ", ".join(f"{n} double" for n in names)
    return dealt.mapInPandas(run, schema)


def ema_mean_seeded(ticks: DataFrame, n: int) -> DataFrame:
    """Exponential mean that starts as the plain mean of the first n prices."""
    k = 2.0 / (n + 1)

    def step(prices: np.ndarray, state: dict) -> list[np.ndarray]:
        out = np.full(len(prices), np.nan)
        at = 0
        if "ema" not in state:
            seed = np.concatenate([state.get("seed", np.zeros(0)), prices[: n - len(state.get("seed", ()))]])
            at = len(seed) - len(state.get("seed", ()))
            state["seed"] = seed
            if len(seed) == n:
                state["ema"] = seed.mean()
                out[at - 1] = state["ema"]
        if "ema" in state and at < len(prices):
            out[at:] = ewm(np.append(state["ema"], prices[at:]), k)[1:]
            state["ema"] = out[-1]
        return [pd.array(out, "Float64").to_numpy(dtype=object, na_value=None) if np.isnan(out).any() else out]

    return _by_symbol(ticks, [f"px_ema_{n}"], step)


def rsi_wilder(ticks: DataFrame, n: int) -> DataFrame:
    """Relative strength with Wilder's smoothing of gains and losses, both from 0; known after n changes."""

    def step(prices: np.ndarray, state: dict) -> list[np.ndarray]:
        change = np.diff(prices, prepend=state.get("last", prices[0]))
        gain, loss = (ewm(np.append(state.get(k, 0.0), np.maximum(sign * change, 0.0)), 1.0 / n)[1:] for k, sign in (("gain", 1), ("loss", -1)))
        seen = state.get("seen", -1) + 1 + np.arange(len(prices))  # changes up to each price; a first price has none
        state.update(last=prices[-1], gain=gain[-1], loss=loss[-1], seen=int(seen[-1]))
        with np.errstate(all="ignore"):
            value = np.where(loss <= 0, 100.0, 100.0 - 100.0 / (1.0 + gain / loss))
        return [np.where(seen >= n, value, None)]

    return _by_symbol(ticks, [f"px_rsi_{n}"], step)


def merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, ["symbol", *ORDER]), parts)


def store_field(ticks: DataFrame, name: str, config: Config = Config()) -> DataFrame:
    """(symbol, ts, seq, value): how an indicator or payload field stood after each tick; rows without a value are left out."""
    if name in ticks.columns:
        out = ticks.select("symbol", "ts", "seq", F.col(name).cast("double").alias("value"))
    else:
        own = with_period(name, config)
        if name not in (*names_of(own), *exponential_names(own)):
            raise KeyError(f"unknown field {name!r}")
        out = indicators(ticks, own, (name,)).select("symbol", "ts", "seq", F.col(name).alias("value"))
    return out.where("value is not null")


def with_period(name: str, config: Config) -> Config:
    """config with the period that an indicator's name carries."""
    from dataclasses import replace

    kind, _, number = name.rpartition("_")
    if number.isdigit():
        field = {"rsi": "rsi", "atr": "atr", "momentum": "momentum", "roc": "momentum", "volume_avg": "volume_avg"}.get(kind)
        if field:
            return replace(config, **{field: int(number)})
        if kind in ("sma", "ema"):
            return replace(config, **{kind: (int(number),)})
    return config
