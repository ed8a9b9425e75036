"""Schemas, interval lengths and pinned categories."""

from __future__ import annotations

from pyspark.sql import types as T

#: Named intervals in seconds.
INTERVALS = {"1m": 60, "3m": 180, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "12h": 43200, "1d": 86400}
#: Higher timeframes that are rebuilt from one-minute bars.
DERIVED = ("3m", "5m", "15m", "30m", "1h", "2h", "4h")
SESSIONS, VOL_BUCKETS = ("Asia", "EU", "US"), ("low", "med", "high")
CLASSES = ("down", "flat", "up")
OHLCV = ("open", "high", "low", "close", "volume")

CANDLE = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in OHLCV],
    T.StructField("close_time", T.TimestampNTZType()),
])
#: A raw kline of twelve positions, as exchanges send it.
KLINE = T.StructType([
    T.StructField("open_time", T.LongType()), *[T.StructField(c, T.StringType()) for c in OHLCV], T.StructField("close_time", T.LongType()), T.StructField("quote_asset_volume", T.StringType()),
    T.StructField("number_of_trades", T.LongType()), T.StructField("taker_buy_base_volume", T.StringType()), T.StructField("taker_buy_quote_volume", T.StringType()), T.StructField("ignore", T.StringType()),
])


def interval_seconds(text: str, default: int = 60) -> int:
    """Seconds of an interval: a named one, else a number with unit s, m, h or d in any case; anything else is `default`."""
    t = (text or "").strip().lower()
    if t in INTERVALS:
        return INTERVALS[t]
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}.get(t[-1:])
    return max(1, int(t[:-1])) * unit if unit and t[:-1].isdigit() else default


def refresh_seconds(interval: str, fraction: float = 1 / 12, low: float = 1.0, high: float = 15.0) -> float:
    """How often an interval is polled: a share of its length within bounds; high <= 0 means no upper bound."""
    s = max(low, interval_seconds(interval) * fraction)
    return min(s, high) if high > 0 else s
