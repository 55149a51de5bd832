"""The ob.* key language: parsing, formatting, and evaluation over ladder rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("bid", "ask")
ATTRIBUTES = ("price", "size", "orders", "notional")
REDUCERS = ("sum", "avg", "min", "max", "count")
META = ("seq", "epoch", "is_stale", "levels.bid", "levels.ask", "last_change_ms")

def profile(depth: int = 5) -> tuple[str, ...]:
    """Keys that describe a book down to a depth: both tops, what lies between them, and each side's sums and their balance."""
    tops = [f"ob.best.{side}.{attribute}" for side in SIDES for attribute in ("price", "size")]
    sums = [f"ob.{metric}.{side}.levels.{depth}{what}" for metric, what in (("cum", ".size"), ("vwap", "")) for side in SIDES]
    return (*tops, "ob.spread", "ob.mid", *sums, f"ob.imbalance.levels.{depth}")


@dataclass(frozen=True)
class Key:
    """metric: best, spread, mid, level, at, range, cum, vwap, imbalance or meta. span: levels (first, last) or prices (low, high)."""

    metric: str
    side: str | None = None
    attribute: str | None = None
    reducer: str | None = None
    by: str | None = None  # levels or price
    span: tuple[float, float] | None = None
    mode: str = "per"


class KeyError_(ValueError):
    """A key that the language doesn't have."""


def _number(text: str) -> float:
    """A price; p stands for the point, which would split the key."""
    if not re.fullmatch(r"-?\d+(p\d+)?", text):
        raise KeyError_(f"not a price: {text!r}")
    return float(text.replace("p", "."))


def _span(text: str, by: str, single_from_one: bool = False) -> tuple[float, float]:
    found = re.fullmatch(r"(-?\d+(?:p\d+)?)-(-?\d+(?:p\d+)?)", text)
    if found:
        low, high = _number(found[1]), _number(found[2])
    elif single_from_one and re.fullmatch(r"\d+", text):
        low, high = 1.0, float(text)
    else:
        raise KeyError_(f"not a range: {text!r}")
    if by == "levels" and (low < 1 or low != int(low) or high != int(high)):
        raise KeyError_("levels count from 1")
    return (low, high) if low <= high else (high, low)


def _one_of(text: str, allowed: tuple[str, ...]) -> str:
    if text not in allowed:
        raise KeyError_(f"{text!r} is none of {', '.join(allowed)}")
    return text


def parse(key: str) -> Key:
    """A Key, or KeyError_. Empty parts between dots are skipped; .per or .agg may end the key."""
    parts = [x for x in key.split(".") if x]
    if not parts or parts[0] != "ob":
        raise KeyError_("an ob key begins with ob.")
    parts = parts[1:]
    mode = parts.pop() if parts and parts[-1] in ("per", "agg") else "per"
    match parts:
        case ["spread" | "mid" as metric]:
            return Key(metric, mode=mode)
        case ["best", side, attribute]:
            return Key("best", _one_of(side, SIDES), _one_of(attribute, ("price", "size")), mode=mode)
        case ["level", side, number, attribute] if number.isdigit() and int(number) >= 1:
            return Key("level", _one_of(side, SIDES), _one_of(attribute, ATTRIBUTES), by="levels", span=(float(number), float(number)), mode=mode)
        case ["at", side, price, attribute]:
            at = _number(price)
            return Key("at", _one_of(side, SIDES), _one_of(attribute, ATTRIBUTES), by="price", span=(at, at), mode=mode)
        case ["range", side, ("levels" | "price") as by, span, "count"]:
            return Key("range", _one_of(side, SIDES), None, "count", by, _span(span, by), mode)
        case ["range", side, ("levels" | "price") as by, span, reducer, attribute]:
            return Key("range", _one_of(side, SIDES), _one_of(attribute, ATTRIBUTES), _one_of(reducer, REDUCERS[:4]), by, _span(span, by), mode)
        case ["cum", side, "levels", number, attribute] if number.isdigit() and int(number) >= 1:
            return Key("cum", _one_of(side, SIDES), _one_of(attribute, ATTRIBUTES), by="levels", span=(1.0, float(number)), mode=mode)
        case ["vwap", side, ("levels" | "price") as by, span]:
            return Key("vwap", _one_of(side, SIDES), by=by, span=_span(span, by, by == "levels"), mode=mode)
        case ["imbalance", ("levels" | "price") as by, span]:
            return Key("imbalance", by=by, span=_span(span, by, by == "levels"), mode=mode)
        case ["meta", *rest] if ".".join(rest) in META:
            return Key("meta", attribute=".".join(rest), mode=mode)
    raise KeyError_(f"unknown key {key!r}")


def _text(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x).replace(".", "p")


def format_key(key: Key) -> str:
    """The shortest text that parses to key."""
    span = f"{_text(key.span[0])}-{_text(key.span[1])}" if key.span else ""
    short = _text(key.span[1]) if key.span and key.by == "levels" and key.span[0] == 1 else span
    body = {
        "spread": lambda: "spread",
        "mid": lambda: "mid",
        "best": lambda: f"best.{key.side}.{key.attribute}",
        "level": lambda: f"level.{key.side}.{_text(key.span[0])}.{key.attribute}",
        "at": lambda: f"at.{key.side}.{_text(key.span[0])}.{key.attribute}",
        "range": lambda: f"range.{key.side}.{key.by}.{span}." + ("count" if key.reducer == "count" else f"{key.reducer}.{key.attribute}"),
        "cum": lambda: f"cum.{key.side}.levels.{_text(key.span[1])}.{key.attribute}",
        "vwap": lambda: f"vwap.{key.side}.{key.by}.{short}",
        "imbalance": lambda: f"imbalance.{key.by}.{short}",
        "meta": lambda: f"meta.{key.attribute}",
    }[key.metric]()
    return f"ob.{body}" + (".agg" if key.mode == "agg" else "")


def _inside(key: Key, tick_size: float) -> Column:
    low, high = key.span
    if key.by == "levels":
        return F.col("lvl").between(int(low), int(high))
    return F.col("price_ticks").between(round(low / tick_size), round(high / tick_size))


def _attribute(key: Key) -> Column:
    if key.mode == "agg" and key.attribute == "orders":
        return F.lit(None).cast("double")  # an aggregated book doesn't know its orders
    return F.col(key.attribute)


def expression(key: Key, tick_size: float = 1e-4, strict: bool = False) -> Column:
    """The aggregate over a symbol's ladder rows (side, lvl, price_ticks, price, size, orders, notional) that a key stands for; null where it isn't a number.

    strict keeps a known quirk of range reductions: over levels min and max are sums, over prices they are 0, and counts are 0.
    """
    of = lambda side: F.col("side") == side
    zero = F.lit(0.0)
    if key.metric == "best":
        found = F.max(F.when(of(key.side) & (F.col("lvl") == 1), F.col(key.attribute)))
        return F.coalesce(found, zero) if key.attribute == "size" else found
    if key.metric in ("spread", "mid"):
        bid, ask = (F.max(F.when(of(s) & (F.col("lvl") == 1), F.col("price"))) for s in SIDES)
        return ask - bid if key.metric == "spread" else (ask + bid) / 2
    if key.metric in ("level", "at"):
        return F.max(F.when(of(key.side) & _inside(key, tick_size), _attribute(key)))
    if key.metric == "cum":
        return F.coalesce(F.sum(F.when(of(key.side) & _inside(key, tick_size), _attribute(key))), zero)
    if key.metric == "range":
        chosen = of(key.side) & _inside(key, tick_size)
        if strict and (key.reducer == "count" or (key.by == "price" and key.reducer in ("min", "max"))):
            some = F.max(F.when(chosen, zero))
            return some if key.by == "levels" else F.coalesce(some, zero)
        if key.reducer == "count":
            found = F.sum(F.when(chosen, 1.0))
        elif strict and key.reducer in ("min", "max"):
            found = F.sum(F.when(chosen, _attribute(key)))
        else:
            found = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[key.reducer](F.when(chosen, _attribute(key)))
        return found if key.by == "levels" else F.coalesce(found, zero)
    if key.metric == "vwap":
        chosen = of(key.side) & _inside(key, tick_size)
        size = F.sum(F.when(chosen, F.col("size")))
        return F.sum(F.when(chosen, F.col("price") * F.col("size"))) / F.when(size > 0, size)
    if key.metric == "imbalance":
        bid, ask = (F.coalesce(F.sum(F.when(of(s) & _inside(key, tick_size), F.col("size"))), zero) for s in SIDES)
        both = bid + ask
        return F.when(both > 0, (bid - ask) / F.when(both > 0, both)).otherwise(zero)
    counts = {"levels.bid": F.sum(F.when(of("bid"), 1.0).otherwise(0.0)), "levels.ask": F.sum(F.when(of("ask"), 1.0).otherwise(0.0))}
    return counts[key.attribute] if key.attribute in counts else F.max(F.col(f"meta_{key.attribute}").cast("double"))


def evaluate(ladder_rows: DataFrame, keys: tuple[str, ...], tick_size: float = 1e-4, meta: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(symbol, a column per key) in one grouped aggregate. meta: (symbol, seq, epoch, is_stale, last_change_ms), a row per symbol.

    A column's name is its key with _ for each dot and dash.
    """
    parsed = {k: parse(k) for k in keys}
    rows = ladder_rows
    if any(p.metric == "meta" for p in parsed.values()):
        names = ("seq", "epoch", "is_stale", "last_change_ms")
        if meta is None:
            rows = rows.withColumns({f"meta_{n}": F.lit(None).cast("double") for n in names})
        else:
            rows = rows.join(meta.select("symbol", *(F.col(n).cast("double").alias(f"meta_{n}") for n in names)), "symbol", "right")
    return rows.groupBy("symbol").agg(*(expression(p, tick_size, strict).alias(re.sub(r"[.-]", "_", k)) for k, p in parsed.items()))


def value_of(key: Key, book, tick_size: float = 1e-4) -> float | None:
    """What expression() gives, of a replay's book as it stands; None where it isn't a number."""

    def rows(side: str) -> list[tuple[int, float]]:
        """(price in ticks, price) of the levels that the key is about."""
        prices = book.ladder(side)
        if key.by == "levels":
            prices = prices[int(key.span[0]) - 1 : int(key.span[1])]
        elif key.by == "price":
            low, high = (round(x / tick_size) for x in key.span)
            prices = [p for p in prices if low <= p <= high]
        return [(p, p * tick_size) for p in prices]

    def attribute(side: str, level: tuple[int, float]) -> float | None:
        size = float(book.total(side, level[0]))
        if key.attribute == "orders":
            return None if key.mode == "agg" or level[0] not in book.queues[side] else float(len(book.queues[side][level[0]]))
        return {"price": level[1], "size": size, "notional": level[1] * size}[key.attribute]

    if key.metric == "best":
        top = book.best(key.side)
        return (float(book.total(key.side, top)) if key.attribute == "size" else top * tick_size) if top is not None else 0.0 if key.attribute == "size" else None
    if key.metric in ("spread", "mid"):
        bid, ask = (book.best(s) for s in SIDES)
        return None if bid is None or ask is None else (ask - bid) * tick_size if key.metric == "spread" else (ask + bid) * tick_size / 2
    if key.metric in ("level", "at", "cum", "range"):
        levels = rows(key.side)
        if key.reducer == "count":
            return float(len(levels)) if levels else None if key.by == "levels" else 0.0
        values = [x for x in (attribute(key.side, level) for level in levels) if x is not None]
        if key.metric in ("level", "at"):
            return values[0] if values else None
        if not values:
            return 0.0 if key.metric == "cum" or key.by == "price" else None
        return {"sum": sum, "avg": lambda v: sum(v) / len(v), "min": min, "max": max}[key.reducer or "sum"](values)
    if key.metric == "vwap":
        levels = [(price, book.total(key.side, at)) for at, price in rows(key.side)]
        size = sum(n for _, n in levels)
        return sum(price * n for price, n in levels) / size if size > 0 else None
    if key.metric == "imbalance":
        bid, ask = (sum(book.total(s, at) for at, _ in rows(s)) for s in SIDES)
        return (bid - ask) / (bid + ask) if bid + ask > 0 else 0.0
    return {"seq": float(book.last_seq), "epoch": float(book.epoch), "is_stale": float(book.stale), "levels.bid": float(len(book.prices["bid"])), "levels.ask": float(len(book.prices["ask"])), "last_change_ms": getattr(book, "change_ms", None)}[key.attribute]
