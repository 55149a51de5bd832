"""Settings, from defaults or an INI-like file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(max(1, int(x)) for x in text.replace(" ", "").split(",") if x.lstrip("-").isdigit())


@dataclass(frozen=True)
class Config:
    """history: rows that running functions and indicators look back on. symbols, fields: optional caps on first-seen keys, 0 for none.

    Periods below 1 become 1, an inverted MACD pair is swapped, a band width of 0 or less becomes 2, an empty list takes its default.
    """

    history: int = 1000
    symbols: int = 0
    sma: tuple[int, ...] = (5, 20)
    ema: tuple[int, ...] = (12, 26)
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    bollinger: int = 20
    band_width: float = 2.0
    rsi: int = 14
    atr: int = 14
    momentum: int = 10
    volume_avg: int = 20
    ta_enabled: bool = True
    price_fields: tuple[str, ...] = ("lastPrice", "price", "last", "px")
    volume_fields: tuple[str, ...] = ("volume", "vol", "qty", "size")
    bid_fields: tuple[str, ...] = ()
    ask_fields: tuple[str, ...] = ()
    timestamp_field: str = ""
    tick_size: float = 1e-4
    negative_prices: bool = False
    parked: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        for name in ("history", "macd_fast", "macd_slow", "macd_signal", "bollinger", "rsi", "atr", "momentum", "volume_avg"):
            put(name, max(1, int(getattr(self, name))))
        for name, default in (("sma", (5, 20)), ("ema", (12, 26))):
            put(name, tuple(max(1, int(x)) for x in getattr(self, name)) or default)
        for name, default in (("price_fields", ("lastPrice", "price", "last", "px")), ("volume_fields", ("volume", "vol", "qty", "size"))):
            put(name, tuple(getattr(self, name)) or default)
        if self.macd_fast > self.macd_slow:
            fast = self.macd_fast
            put("macd_fast", self.macd_slow)
            put("macd_slow", fast)
        if self.band_width <= 0:
            put("band_width", 2.0)


#: File keys and the settings they name (fixed values of the file format).
KEYS = {
    "taHistoryMax": "history", "taSMA": "sma", "taEMA": "ema", "taMACD_fast": "macd_fast", "taMACD_slow": "macd_slow", "taMACD_signal": "macd_signal",
    "taBBands_n": "bollinger", "taBBands_stdK": "band_width", "taRSI": "rsi", "taATR": "atr", "taMomentum": "momentum", "taVolAvg": "volume_avg",
    "maxSymbols": "symbols", "allowNegativePrices": "negative_prices",
}
#: Keys of a tick source, under market.source. or the older source.
SOURCE_KEYS = {"priceFields": "price_fields", "volumeFields": "volume_fields", "bidFields": "bid_fields", "askFields": "ask_fields", "timestampField": "timestamp_field", "taEnabled": "ta_enabled"}
KEYS |= {f"{prefix}.{k}": name for prefix in ("market.source", "source") for k, name in SOURCE_KEYS.items()}


def parse_lines(text: str) -> dict[str, str]:
    """key = value lines; # and ; begin comments, lines without = are skipped."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#;" and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def load(text: str, namespaces: dict[str, Callable[[str, str], None]] | None = None) -> Config:
    """Config from a file's text. Values that can't be read keep their default; unknown keys are parked, and replayed to the reader of their prefix."""
    kinds = {f.name: f.type for f in fields(Config)}
    given, parked = {}, {}
    for key, value in parse_lines(text).items():
        name = KEYS.get(key, key if key in kinds and key != "parked" else None)
        if name is None:
            parked[key] = value
            continue
        kind = str(kinds[name])
        try:
            if kind.startswith("tuple[int"):
                given[name] = _numbers(value)
            elif kind.startswith("tuple"):
                given[name] = tuple(x.strip() for x in value.split(",") if x.strip())
            elif kind == "bool":
                given[name] = value.lower() in ("1", "true", "yes", "on")
            elif kind == "str":
                given[name] = value
            else:
                given[name] = float(value) if kind == "float" else int(value)
        except ValueError:
            continue
    for key, value in parked.items():
        for prefix, reader in (namespaces or {}).items():
            if key.startswith(prefix + "."):
                reader(key, value)
    return replace(Config(**given), parked=parked)
