"""Keyed state for streams: running reductions, count batching, indicators and books, with applyInPandasWithState.

Non-time windows don't exist on streams, so a symbol's bounded history is its state. Within a micro-batch a symbol's
rows are put in order (ts, seq); rows that come later than a newer batch's are taken as they arrive.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, pd.DataFrame], pd.DataFrame]


def keyed(stream: DataFrame, step: Step, schema: str, key: str = "symbol", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """step(state, ordered rows of one key) for each key and micro-batch; state is a dict that survives between them."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(list(order), ignore_index=True)
        out = step(own, rows)
        state.update((pickle.dumps(own),))
        yield out

    return stream.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def running(stream: DataFrame, f: Callable[[list[float]], float], rows: int = 1000, value: str = "value") -> DataFrame:
    """(symbol, ts, seq, value): f of the last `rows` values at every input; an exception takes the input back and emits nothing."""

    def step(state: dict, group: pd.DataFrame) -> pd.DataFrame:
        history = state.setdefault("history", deque(maxlen=rows))
        out = []
        for symbol, ts, seq, x in group[["symbol", "ts", "seq", value]].itertuples(index=False, name=None):
            before = history[0] if len(history) == rows else None
            history.append(float(x))
            try:
                out.append((symbol, ts, seq, float(f(list(history)))))
            except Exception:
                history.pop()
                if before is not None:
                    history.appendleft(before)
        return pd.DataFrame(out, columns=["symbol", "ts", "seq", "value"])

    return keyed(stream, step, "symbol string, ts timestamp, seq long, value double")


def batched(stream: DataFrame, arity: int, value: str = "value") -> DataFrame:
    """(symbol, ts, seq, pos, value): every `arity` arrivals of a symbol go on one by one, at the time of the last."""

    def step(state: dict, group: pd.DataFrame) -> pd.DataFrame:
        waiting = state.setdefault("waiting", [])
        out = []
        for symbol, ts, seq, x in group[["symbol", "ts", "seq", value]].itertuples(index=False, name=None):
            waiting.append(float(x))
            if len(waiting) == arity:
                out += [(symbol, ts, seq, k, v) for k, v in enumerate(waiting)]
                waiting.clear()
        return pd.DataFrame(out, columns=["symbol", "ts", "seq", "pos", "value"])

    return keyed(stream, step, "symbol string, ts timestamp, seq long, pos int, value double")


def indicators(stream: DataFrame, period: int = 12, rows: int = 1000) -> DataFrame:
    """(symbol, ts, seq, sma, ema, momentum) of price over the bounded history, null until there are enough ticks."""
    k = 2.0 / (period + 1)

    def step(state: dict, group: pd.DataFrame) -> pd.DataFrame:
        history = state.setdefault("history", deque(maxlen=rows))
        out = []
        for symbol, ts, seq, x in group[["symbol", "ts", "seq", "price"]].itertuples(index=False, name=None):
            oldest = history[0] if len(history) == rows else None
            history.append(float(x))
            if len(history) == 1:
                state["ema"] = float(x)
            else:
                state["ema"] = k * float(x) + (1 - k) * state["ema"]
                if oldest is not None:  # the seed moves on with the history
                    state["ema"] += (1 - k) ** (rows - 1) * (history[0] - ((1 - k) * oldest + k * history[0]))
            n = len(history)
            last = list(history)[-period:]
            out.append((symbol, ts, seq, sum(last) / period if n >= period else None, state["ema"] if n >= period else None, x - history[-period - 1] if n > period else None))
        return pd.DataFrame(out, columns=["symbol", "ts", "seq", "sma", "ema", "momentum"]).astype({"sma": float, "ema": float, "momentum": float})

    return keyed(stream, step, "symbol string, ts timestamp, seq long, sma double, ema double, momentum double")


def book_changes(stream: DataFrame) -> DataFrame:
    """replay.DELTA rows of a stream of quantised book events; the state is a symbol's live orders."""
    from tickloom.operators.replay import DELTA, FIELDS, Book, changes_of

    def plain(v):
        return None if v is None or v != v else v

    def step(state: dict, group: pd.DataFrame) -> pd.DataFrame:
        book = state.setdefault("book", Book())
        out = []
        for values in group[list(FIELDS)].itertuples(index=False, name=None):
            e = {k: plain(v) for k, v in zip(FIELDS, values, strict=True)}
            e |= {k: int(e[k]) for k in ("seq", "feed_id", "epoch", "order_id", "price_ticks", "size") if e[k] is not None}
            rows = changes_of(book, e, state.get("number", 0) + 1)
            if rows:
                state["number"] = state.get("number", 0) + 1
                out += rows
        frame = pd.DataFrame(out, columns=["symbol", "number", "seq", "side", "price_ticks", "total", "bid_ticks", "ask_ticks"])
        return frame.astype({"bid_ticks": "Int64", "ask_ticks": "Int64"})

    return keyed(stream, step, DELTA, order=("seq",))
