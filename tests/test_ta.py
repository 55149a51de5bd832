import math
import random

from helpers import folded, mean, median, same, ticks, variance

from tickloom.config import Config
from tickloom.operators import ta

C = Config(history=40, sma=(5, 20), ema=(4, 12))


def oracle(history):
    """Indicators of a history of (price, volume), by name; absent ones are missing."""
    p, q, n = [x for x, _ in history], [y for _, y in history], len(history)
    out = {"lastPrice": p[-1], "openPrice": p[0], "highPrice": max(p), "lowPrice": min(p), "mean": mean(p), "median": median(p)}
    if n < 2:
        return out
    out |= {"prevClose": p[-2], "volume": q[-1], "vwap": sum(a * b for a, b in history) / sum(q) if sum(q) > 0 else None}
    out |= {f"sma_{k}": mean(p[-k:]) for k in C.sma if n >= k} | {f"ema_{k}": folded(p, 2 / (k + 1)) for k in C.ema if n >= k}
    d = [b - a for a, b in zip(p, p[1:], strict=False)]
    if n >= 15:
        gain, loss = mean([max(x, 0) for x in d[-14:]]), mean([max(-x, 0) for x in d[-14:]])
        out |= {"rsi_14": 100 - 100 / (1 + gain / max(loss, 1e-6)), "atr_14": mean([abs(x) for x in d[-14:]])}
    if n >= 11:
        out |= {"momentum_10": p[-1] - p[-11], "roc_10": 100 * (p[-1] - p[-11]) / p[-11] if abs(p[-11]) > 1e-6 else None}
    if n >= 20:
        sd = math.sqrt(variance(p[-20:]))
        out |= {"bollinger_upper": mean(p[-20:]) + 2 * sd, "bollinger_lower": mean(p[-20:]) - 2 * sd, "volume_avg_20": mean(q[-20:]), "volatility_rank": min(sd / abs(mean(p)), 1)}
    out["obv"] = sum(((x > 0) - (x < 0)) * v for x, v in zip(d, q[1:], strict=True))
    if n >= 26:
        out["macd_line"] = folded(p, 2 / 13) - folded(p, 2 / 27)
    return out


def test_suite_against_oracle(spark):
    pick = random.Random(11)
    rows = [(pick.choice("AB"), round(pick.uniform(1, 99), 2), float(pick.randrange(5))) for _ in range(200)]
    got = {r["seq"]: r.asDict() for r in ta.full_suite(ticks(spark, rows), C).collect()}
    seen = {"A": [], "B": []}
    for seq, (symbol, p, q) in enumerate(rows):
        seen[symbol] = [*seen[symbol], (p, q)][-C.history :]
        want = oracle(seen[symbol])
        for name, value in got[seq].items():
            if name in ("symbol", "ts", "seq", "pos", "bollinger_middle", "macd_signal", "macd_histogram"):
                continue
            value = None if value is None or math.isnan(value) else value
            assert same(value, want.get(name)), (seq, name, value, want.get(name))


def test_macd_signal_is_an_average_of_the_last_nine(spark):
    rows = [("A", float(k * k % 37), 1.0) for k in range(60)]
    lines = [r["macd_line"] for r in ta.exponential(ticks(spark, rows), C).orderBy("seq").collect()]
    got = [r["macd_signal"] for r in ta.exponential(ticks(spark, rows), C).orderBy("seq").collect()]
    for i, value in enumerate(got):
        if i >= 25 + 8:
            assert same(value, folded(lines[i - 8 : i + 1], 0.2))
        else:
            assert value is None or math.isnan(value)


def test_blocks_of_emas(spark):
    rows = ticks(spark, [("A", float(k * 7 % 31), 1.0) for k in range(900)])
    few = {r["seq"]: r for r in ta.exponential(rows, C, target=1, bucket_seconds=10).collect()}
    for r in ta.exponential(rows, C).collect():
        for name in ("ema_4", "ema_12", "macd_line", "macd_signal"):
            a, b = r[name], few[r["seq"]][name]
            a, b = (None if x is None or math.isnan(x) else x for x in (a, b))
            assert same(a, b), (r["seq"], name)


def test_known_small_values(spark):
    last = ta.suite(ticks(spark, [("A", 1.0, 10.0), ("A", 3.0, 20.0), ("A", 2.0, 5.0)])).orderBy("seq").collect()[-1]
    want = {"openPrice": 1, "lastPrice": 2, "highPrice": 3, "lowPrice": 1, "prevClose": 3, "mean": 2, "median": 2}
    assert all(last[k] == v for k, v in want.items()) and same(last["vwap"], 80 / 35)
    assert last["rsi_14"] is None and last["atr_14"] is None and last["bollinger_upper"] is None
    long = ta.suite(ticks(spark, [("A", float(p), 2.0 * p) for p in range(1, 26)])).orderBy("seq").collect()[-1]
    assert long["sma_5"] == 23 and long["sma_20"] == 15.5 and long["volume"] == 50


def test_strict_warm_up(spark):
    got = ta.strict_nan(ta.full_suite(ticks(spark, [("A", float(p), 1.0) for p in range(1, 41)])), Config()).orderBy("seq").collect()
    assert got[0]["sma_5"] is None and math.isnan(got[1]["sma_5"]) and got[4]["sma_5"] == 3
    assert math.isnan(got[3]["macd_line"]) and got[3]["macd_signal"] == 0 and math.isnan(got[30]["macd_signal"]) and not math.isnan(got[39]["macd_signal"])


def test_light(spark):
    got = ta.full_suite(ticks(spark, [("A", 2.0, None), ("A", 5.0, 3.0)]), Config(ta_enabled=False)).orderBy("seq").collect()
    assert got[1].asDict() | {"ts": 0} == {"symbol": "A", "ts": 0, "seq": 1, "pos": 0, "lastPrice": 5.0, "volume": 3.0, "openPrice": 2.0, "highPrice": 5.0, "lowPrice": 2.0}


def test_mean_seeded_ema(spark):
    got = [r["px_ema_3"] for r in ta.ema_mean_seeded(ticks(spark, [("A", float(p), 1.0) for p in (1, 2, 3, 4)]), 3).orderBy("seq").collect()]
    assert [x for x in got if x is not None and not math.isnan(x)] == [2.0, 3.0]


def test_wilder(spark):
    pick = random.Random(2)
    prices = [pick.uniform(1, 9) for _ in range(40)]
    got = [r["px_rsi_5"] for r in ta.rsi_wilder(ticks(spark, [("A", p, 1.0) for p in prices]), 5).orderBy("seq").collect()]
    gain = loss = 0.0
    for i in range(1, len(prices)):
        d = prices[i] - prices[i - 1]
        gain, loss = (gain * 4 + max(d, 0)) / 5, (loss * 4 + max(-d, 0)) / 5
        if i >= 5:
            assert same(got[i], 100 - 100 / (1 + gain / loss) if loss > 0 else 100)
        else:
            assert got[i] is None or math.isnan(got[i])
