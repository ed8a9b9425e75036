"""Recursive indicators of one series as loops over its rows, which the blocks must equal."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.operators.folds import EMA_SPANS, FOLD_COLUMNS


def ema(x: np.ndarray, span: float) -> np.ndarray:
    """y = y + a (x - y), from the first value on."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def weighted_mean(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Exponentially weighted mean with weights that sum to one from the first value on; leading nulls are skipped, `least` values needed."""
    return pd.Series(x).ewm(alpha=alpha, adjust=True, min_periods=least).mean().to_numpy()


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Relative strength; 50 where there is no average loss yet."""
    d = np.diff(close, prepend=np.nan)
    gain, loss = np.where(np.isnan(d), np.nan, np.maximum(d, 0)), np.where(np.isnan(d), np.nan, np.maximum(-d, 0))
    g, f = weighted_mean(gain, 1 / n, n), weighted_mean(loss, 1 / n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + g / np.where(f == 0, np.nan, f))
    return np.where(np.isnan(out), 50.0, out)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    prev = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - prev), np.abs(low - prev)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    out = weighted_mean(true_range(high, low, close), 1 / n, n)
    first = out[~np.isnan(out)][:1]
    return np.where(np.isnan(out), first[0] if len(first) else 0.0, out)


def kama(x: np.ndarray, n: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive mean: the efficiency of the last n steps sets the weight; without n steps it is the slow one."""
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    weight = np.full(len(x), b)
    if len(x) > n:
        path = np.lib.stride_tricks.sliding_window_view(np.abs(np.diff(x)), n).sum(axis=1)
        moved = np.abs(x[n:] - x[:-n])
        weight[n:] = np.where(path > 0, (moved / np.where(path > 0, path, 1.0) * (a - b) + b) ** 2, b)
    out, y = [], x[0] if len(x) else 0.0
    for v, w in zip(x.tolist(), weight.tolist()):
        y = y + w * (v - y)
        out.append(y)
    return np.asarray(out, np.float64)


def swings(close: np.ndarray, width: np.ndarray, seconds: np.ndarray, k: float = 1.5) -> tuple[np.ndarray, ...]:
    """Distances and seconds from the last swing high and low; a price beyond the last one by k mean ranges moves it."""
    rows: list[tuple] = []
    hi = lo = hi_t = lo_t = None
    for c, d, t in zip(close.tolist(), (k * np.nan_to_num(width)).tolist(), seconds.tolist()):
        if hi is None:
            hi = lo = c
            hi_t = lo_t = t
        if c >= hi + d:
            hi, hi_t = c, t
        if c <= lo - d:
            lo, lo_t = c, t
        rows.append((abs(c - hi), abs(c - lo), t - hi_t, t - lo_t))
    return tuple(np.asarray(rows, np.float64).reshape(-1, 4).T)


def _mean14(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rolling(14, min_periods=1).mean().to_numpy()


def fold_series(pdf: pd.DataFrame) -> pd.DataFrame:
    """All recursive columns of one series."""
    pdf = pdf.sort_values("ts", kind="stable")
    high, low, close = (pdf[c].to_numpy(np.float64) for c in ("high", "low", "close"))
    seconds = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64) / 1e6
    e = {s: ema(close, s) for s in EMA_SPANS}
    macd = e[12] - e[26]
    signal = ema(macd, 9)
    s = swings(close, _mean14(high - low), seconds)
    values = [*e.values(), macd, signal, macd - signal, e[12] - e[26], e[50] - e[200], np.diff(e[21], prepend=e[21][:1]), np.where(close == 0, 0.0, np.abs(e[21] - e[55]) / np.where(close == 0, 1.0, close)), rsi(close), atr(high, low, close), kama(close), *s]
    return pd.concat([pdf, pd.DataFrame(dict(zip(FOLD_COLUMNS, values)), index=pdf.index)], axis=1)
