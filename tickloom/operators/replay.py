"""Sequential book semantics: queues, trades in order, priority, snapshots, gaps, and what each event changed.

The Book is plain Python; replay() streams each symbol's events through one in order, so memory holds live orders only.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import obkeys

#: What a book counts.
COUNTERS = ("adds", "updates", "deletes", "trades", "priorities", "levels", "snapshots", "resets", "gaps", "ignored_stale", "unknown_orders", "unmatched_trades", "synthetic_ids")


class Book:
    """Orders by side and price in ticks, each level a queue; levels that come aggregated lie beside them. Prices are kept sorted, totals up to date."""

    def __init__(self):
        self.queues: dict[str, dict[int, OrderedDict]] = {"bid": {}, "ask": {}}
        self.orders: dict[tuple, tuple[str, int]] = {}
        self.summaries: dict[str, dict[int, int]] = {"bid": {}, "ask": {}}
        self.prices: dict[str, list[int]] = {"bid": [], "ask": []}
        self.totals: dict[str, dict[int, int]] = {"bid": {}, "ask": {}}
        self.stale, self.last_seq, self.epoch, self.synthetic, self.snapshot_seq = False, 0, 0, 0, None
        self.changed: set[tuple[str, int]] = set()
        self.counts = dict.fromkeys(COUNTERS, 0)

    def total(self, side: str, price: int) -> int:
        return self.totals[side].get(price, 0) + self.summaries[side].get(price, 0)

    def best(self, side: str) -> int | None:
        prices = self.prices[side]
        return (prices[-1] if side == "bid" else prices[0]) if prices else None

    def ladder(self, side: str) -> list[int]:
        """The side's prices, best first."""
        return self.prices[side][::-1] if side == "bid" else self.prices[side]

    def _touch(self, side: str, price: int) -> None:
        """Notes a change of a level, and keeps its price while it has orders or a summary."""
        self.changed.add((side, price))
        prices, there = self.prices[side], price in self.queues[side] or price in self.summaries[side]
        at = bisect_left(prices, price)
        known = at < len(prices) and prices[at] == price
        if there and not known:
            insort(prices, price)
        elif known and not there:
            del prices[at]

    def _resize(self, side: str, price: int, by: int) -> None:
        self.totals[side][price] = self.totals[side].get(price, 0) + by
        if price not in self.queues[side]:
            self.totals[side].pop(price)

    def _take(self, key: tuple) -> tuple[str, int, int] | None:
        at = self.orders.pop(key, None)
        if at is None:
            return None
        side, price = at
        queue = self.queues[side][price]
        size = queue.pop(key)
        if not queue:
            del self.queues[side][price]
        self._resize(side, price, -size)
        self._touch(side, price)
        return side, price, size

    def _put(self, key: tuple, side: str, price: int, size: int) -> None:
        self.queues[side].setdefault(price, OrderedDict())[key] = size
        self.orders[key] = (side, price)
        self._resize(side, price, size)
        self._touch(side, price)

    def add(self, key: tuple | None, side: str, price: int, size: int) -> tuple:
        """At the back of its level; a known order is taken out first; without an id it gets one of its own."""
        if key is None or not key[-1]:
            self.synthetic += 1
            self.counts["synthetic_ids"] += 1
            key = (*(key or (0,))[:-1], -self.synthetic)
        self._take(key)
        self._put(key, side, price, size)
        return key

    def update(self, key: tuple, price: int | None, size: int | None) -> bool:
        """A new size keeps the place in the queue, a new price loses it, a size of 0 removes."""
        at = self.orders.get(key)
        if at is None:
            return False
        side, now = at
        old = self.queues[side][now][key]
        if size == 0:
            self._take(key)
        elif price is not None and price != now:
            self._take(key)
            self._put(key, side, price, old if size is None else size)
        elif size is not None and size != old:
            self.queues[side][now][key] = size
            self._resize(side, now, size - old)
            self._touch(side, now)
        else:
            return False
        return True

    def delete(self, key: tuple) -> bool:
        return self._take(key) is not None

    def prioritise(self, key: tuple) -> bool:
        """To the back of its level."""
        at = self.orders.get(key)
        if at is None:
            return False
        self.queues[at[0]][at[1]].move_to_end(key)
        return True

    def trade(self, price: int, size: int, aggressor: str | None) -> bool:
        """Takes from the queue at exactly that price, first come first; the excess is ignored."""
        side = {"buy": "ask", "sell": "bid"}.get(aggressor or "")
        if side is None:
            bid, ask = self.best("bid"), self.best("ask")
            side = "bid" if bid is not None and price <= bid else "ask" if ask is not None and price >= ask else None
            if side is None:
                return False
        queue = self.queues[side].get(price)
        if not queue:
            return False
        for key in list(queue):
            if size <= 0:
                break
            take = min(size, queue[key])
            size -= take
            if take == queue[key]:
                self._take(key)
            else:
                queue[key] -= take
                self._resize(side, price, -take)
        self._touch(side, price)
        return True

    def summary(self, side: str, price: int, size: int) -> None:
        """An aggregated level's new total; 0 removes it."""
        if size > 0:
            self.summaries[side][price] = size
        else:
            self.summaries[side].pop(price, None)
        self._touch(side, price)

    def clear(self) -> None:
        for side in self.queues:
            self.changed |= {(side, p) for p in self.prices[side]}
        self.queues, self.summaries, self.orders = {"bid": {}, "ask": {}}, {"bid": {}, "ask": {}}, {}
        self.prices, self.totals = {"bid": [], "ask": []}, {"bid": {}, "ask": {}}

    def on_seq(self, seq: int) -> bool:
        """False, and stale from then on, if seq doesn't follow; the first is taken as it comes."""
        if self.stale or (self.last_seq and seq != self.last_seq + 1):
            self.counts["gaps"] += not self.stale
            self.stale = True
            return False
        self.last_seq = seq
        return True

    def reset(self, epoch: int) -> None:
        self.epoch, self.stale, self.last_seq, self.snapshot_seq = epoch, True, 0, None

    def begin_snapshot(self, seq: int) -> None:
        """The whole book goes, and staleness ends."""
        self.clear()
        self.stale, self.last_seq, self.snapshot_seq = False, seq, seq

    def snapshot(self, orders: list[tuple], seq: int) -> None:
        """Replaces the whole book by orders (key, side, price, size), and ends staleness."""
        self.begin_snapshot(seq)
        for key, side, price, size in orders:
            self.add(key, side, price, size)

    def apply(self, e: dict, sequenced: bool = False) -> None:
        """One event as a dict of BOOK_EVENT's fields, with price_ticks.

        Events of kind snapshot (orders) and snapshot_level (aggregated levels) that share a seq are one snapshot, whose first replaces the
        book. A stale book takes nothing else. sequenced: other events' seq must follow each other, or the book is stale.
        """
        kind, counts = e["kind"], self.counts
        if kind == "reset":
            counts["resets"] += 1
            self.reset(e.get("epoch") or 0)
            return
        key = (e.get("feed_id") or 0, e.get("epoch") or 0, e.get("order_id") or 0)
        side = "ask" if e.get("side") == "ask" else "bid"
        price, size = e.get("price_ticks"), e.get("size")
        if kind in ("snapshot", "snapshot_level"):
            if e.get("seq") != self.snapshot_seq or self.stale:
                counts["snapshots"] += 1
                self.begin_snapshot(e.get("seq") or 0)
            if price is not None and size:
                self.add(key, side, price, size) if kind == "snapshot" else self.summary(side, price, size)
            return
        if self.stale or (sequenced and not self.on_seq(e["seq"])):
            counts["ignored_stale"] += 1
            return
        if kind == "add":
            counts["adds"] += 1
            self.add(key, side, price, size)
        elif kind == "update" and (size is None or size > 0):
            counts["updates"] += 1
            counts["unknown_orders"] += key not in self.orders
            self.update(key, price, size)
        elif kind == "delete":
            counts["deletes"] += 1
            counts["unknown_orders"] += not self.delete(key)
        elif kind == "priority":
            counts["priorities"] += 1
            counts["unknown_orders"] += not self.prioritise(key)
        elif kind == "trade":
            counts["trades"] += 1
            counts["unmatched_trades"] += not self.trade(price, size, e.get("aggressor"))
        elif kind == "level":
            counts["levels"] += 1
            self.summary(side, price, size or 0)

    def dump(self) -> list[tuple[str, int, int, int]]:
        """(side, price, total, orders) of every level, asks from the highest and then bids from the highest."""
        return [(side, p, self.total(side, p), len(self.queues[side].get(p, ()))) for side in ("ask", "bid") for p in reversed(self.prices[side])]


FIELDS = ("symbol", "seq", "kind", "feed_id", "epoch", "order_id", "side", "price_ticks", "size", "aggressor")
DELTA = "symbol string, number long, seq long, side string, price_ticks long, total long, bid_ticks long, ask_ticks long"


def _plain(value):
    return None if value is None or value != value else value


def changes_of(book: Book, event: dict, number: int, sequenced: bool = False) -> list[tuple]:
    """Applies an event; a row per changed level whose total differs, with the top of the book if that moved."""
    book.changed = set()
    tops = (book.best("bid"), book.best("ask"))
    book.apply(event, sequenced)
    now = (book.best("bid"), book.best("ask"))
    shown = now if now != tops else (None, None)
    return [(event["symbol"], number, event["seq"], side, price, book.total(side, price), *shown) for side, price in sorted(book.changed)]


def _streamed(events: DataFrame, schema: str, fields: tuple[str, ...], rows_of: Callable[[Book, dict], list[tuple]], nullable: dict[str, str] | None = None) -> DataFrame:
    """rows_of(book, event) over each symbol's events in order of seq, in one task that holds its live orders alone; symbols spread over tasks."""
    dealt = events.select(*fields).repartition("symbol").sortWithinPartitions("symbol", "seq")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, book = None, Book()
        whole = ("seq", "feed_id", "epoch", "order_id", "price_ticks", "size")
        for part in parts:
            out = []
            for values in part.itertuples(index=False, name=None):
                e = {k: _plain(v) for k, v in zip(fields, values, strict=True)}
                e |= {k: int(e[k]) for k in whole if e[k] is not None}
                if e["symbol"] != symbol:
                    symbol, book = e["symbol"], Book()
                out += rows_of(book, e)
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype(nullable or {})

    return dealt.mapInPandas(run, schema)


def replay(events: DataFrame, sequenced: bool = False) -> DataFrame:
    """DELTA rows of quantised events: what each event that changed the book left of the levels it touched, numbered per symbol from 1.

    A symbol's events pass in order of seq through one task, which holds its live orders alone; symbols spread over tasks. sequenced: a
    seq that doesn't follow makes the book stale until the next snapshot, as a reset does.
    """

    def rows_of(book: Book, e: dict) -> list[tuple]:
        rows = changes_of(book, e, getattr(book, "number", 0) + 1, sequenced)
        if rows:
            book.number = getattr(book, "number", 0) + 1
        return rows

    return _streamed(events, DELTA, FIELDS, rows_of, {"bid_ticks": "Int64", "ask_ticks": "Int64"})


def key_values(events: DataFrame, keys: tuple[str, ...], tick_size: float = 1e-4, sequenced: bool = False) -> DataFrame:
    """(symbol, ts, seq, key, value) of ob keys after each event that changed the book or its staleness; value is null where it isn't a number."""
    parsed = {k: obkeys.parse(k) for k in keys}

    def rows_of(book: Book, e: dict) -> list[tuple]:
        book.changed, stale = set(), book.stale
        book.apply(e, sequenced)
        if not book.changed and stale == book.stale:
            return []
        book.change_ms = int(e["ts"].timestamp() * 1000) if book.changed else getattr(book, "change_ms", None)
        return [(e["symbol"], e["ts"], e["seq"], k, obkeys.value_of(p, book, tick_size)) for k, p in parsed.items()]

    return _streamed(events, "symbol string, ts timestamp_ntz, seq long, key string, value double", (*FIELDS, "ts"), rows_of)


def provider(events: DataFrame, tick_size: float = 1e-4, sequenced: bool = False) -> Callable[[str | None, str], DataFrame]:
    """What a catalog's namespace ob reads: of a symbol, or of all, the values (symbol, ts, seq, value) of a key after each change of the book of quantised events."""

    def read(symbol: str | None, key: str) -> DataFrame:
        own = events if symbol is None else events.where(F.col("symbol") == symbol)
        return key_values(own, (key,), tick_size, sequenced).where("value is not null").select("symbol", "ts", "seq", "value")

    return read


def counters(events: DataFrame, sequenced: bool = False) -> DataFrame:
    """(symbol, a column for each of COUNTERS) after all events; staleness decides what counts as ignored, so events pass in order."""

    def rows_of(book: Book, e: dict) -> list[tuple]:
        before = dict(book.counts)
        book.apply(e, sequenced)
        return [(e["symbol"], *(book.counts[c] - before[c] for c in COUNTERS))]

    each = _streamed(events, "symbol string, " + ", ".join(f"{c} long" for c in COUNTERS), FIELDS, rows_of)
    return each.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in COUNTERS))
