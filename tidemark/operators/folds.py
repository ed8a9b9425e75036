"""Recursive indicators over series in blocks.

Every linear indicator is a step y -> a y + b, so a block maps the state that comes in to the one that goes out by a matrix and a vector. The
swing levels are thresholds: a level stays until a price passes it by some distance, so a block maps levels to levels by the first record
that passes them. One pass finds these maps for all blocks but the last of a series, a scan over one row for each block gives the state
that each block begins with, and a second pass computes the columns. A task holds one block with its halo.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.blocks import BLOCK_ROWS, block_states, haloed, placed

#: Spans and periods of the recursive indicators.
EMA_SPANS = (9, 12, 21, 26, 50, 55, 200)
MEAN_ROWS, SWING = 14, 1.5
KAMA = (10, 2, 30)
FOLD_COLUMNS = [
    *[f"ema_{s}" for s in EMA_SPANS], "macd", "macd_signal", "macd_hist", "trend_ema12_26", "trend_ema50_200", "trend_slope", "trend_adx_proxy", "rsi_14", "atr_14", "kama",
    "swing_dist_high", "swing_dist_low", "swing_time_high", "swing_time_low",
]
#: Rows that a block needs of the one before.
HALO = 14
#: The state: means by span, the signal's mean, sums and weight of gains and losses, sum and weight of ranges, the adaptive mean.
STATE = [*EMA_SPANS, "signal", "gain", "loss", "weight", "range", "range_weight", "kama"]
AT = {n: i for i, n in enumerate(STATE)}
_CHUNK = 64
#: Prices this near to a level's threshold are looked at one by one.
TINY = 1e-9


def recurrence(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    """y_t = a_t y_(t-1) + b_t, from y on: chunks side by side from zero, then the chunks' maps one after another."""
    n = len(a)
    m = -(-n // _CHUNK)
    a2, b2 = np.ones(m * _CHUNK), np.zeros(m * _CHUNK)
    a2[:n], b2[:n] = a, b
    a2, b2 = a2.reshape(m, _CHUNK), b2.reshape(m, _CHUNK)
    for k in range(1, _CHUNK):
        b2[:, k] += a2[:, k] * b2[:, k - 1]
        a2[:, k] *= a2[:, k - 1]
    start = np.empty(m)
    for i, (p, q) in enumerate(zip(a2[:, -1].tolist(), b2[:, -1].tolist())):
        start[i] = y
        y = p * y + q
    return (a2 * start[:, None] + b2).ravel()[:n]


def decay(span: float) -> float:
    return 1 - 2 / (span + 1)


def kama_weights(x: np.ndarray) -> np.ndarray:
    """The efficiency of the last n steps sets the weight; without n steps it is the slow one."""
    n, fast, slow = KAMA
    a, b = 2 / (fast + 1), 2 / (slow + 1)
    weight = np.full(len(x), b)
    if len(x) > n:
        path = np.lib.stride_tricks.sliding_window_view(np.abs(np.diff(x)), n).sum(axis=1)
        moved = np.abs(x[n:] - x[:-n])
        weight[n:] = np.where(path > 0, (moved / np.where(path > 0, path, 1.0) * (a - b) + b) ** 2, b)
    return weight


class Steps:
    """A block's own rows, and what its recurrences take from them."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("_i", kind="stable")
        own = pdf["_own"].to_numpy(bool)
        h = int((~own).sum())  # the halo comes first
        high, low, close = (pdf[c].to_numpy(np.float64) for c in ("high", "low", "close"))
        prev = np.concatenate([[np.nan], close[:-1]])
        d = close - prev
        self.rows, self.first, self.n = pdf[own], int(pdf["_i"].iat[h]), len(pdf) - h
        self.close = close[h:]
        self.gain, self.loss = np.maximum(d, 0)[h:], np.maximum(-d, 0)[h:]
        self.range = np.fmax(high - low, np.fmax(np.abs(high - prev), np.abs(low - prev)))[h:]
        self.weight = kama_weights(close)[h:]
        width = pd.Series(high - low).rolling(MEAN_ROWS, min_periods=1).mean().to_numpy()
        self.width = SWING * np.nan_to_num(width)[h:]
        self.seconds = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)[h:] / 1e6

    def mean(self, x: np.ndarray, span: float, y: float) -> np.ndarray:
        """y + a (x - y) from y on."""
        return pd.Series(np.concatenate([[y], x])).ewm(span=span, adjust=False).mean().to_numpy()[1:]

    def weighted(self, x: np.ndarray, y: float) -> np.ndarray:
        """Sums with weights that fall by 13/14; a missing value leaves them as they are."""
        known = ~np.isnan(x)
        return recurrence(np.where(known, 1 - 1 / MEAN_ROWS, 1.0), np.where(known, x, 0.0), y)

    def means(self, z: np.ndarray) -> dict:
        """All linear columns, from the state z on."""
        e = {s: self.mean(self.close, s, z[AT[s]]) for s in EMA_SPANS}
        signal = self.mean(e[12] - e[26], 9, z[AT["signal"]])
        one = np.where(np.isnan(self.gain), np.nan, 1.0)
        w = {k: self.weighted(x, z[AT[k]]) for k, x in (("gain", self.gain), ("loss", self.loss), ("weight", one), ("range", self.range), ("range_weight", np.where(np.isnan(self.range), np.nan, 1.0)))}
        return e | {"signal": signal} | w | {"kama": recurrence(1 - self.weight, self.weight * self.close, z[AT["kama"]])}

    def linear(self) -> tuple[np.ndarray, np.ndarray]:
        """The matrix and vector of the block's map of states."""
        n, m = self.n, np.zeros((len(STATE), len(STATE)))
        out = self.means(np.zeros(len(STATE)))
        for s in EMA_SPANS:
            m[AT[s], AT[s]] = decay(s) ** n
        m[AT["signal"], AT["signal"]] = decay(9) ** n
        t = np.arange(1, n + 1)
        for s, sign in ((12, 1.0), (26, -1.0)):
            m[AT["signal"], AT[s]] = sign * self.mean(decay(s) ** t, 9, 0.0)[-1]
        for names, x in ((("gain", "loss", "weight"), self.gain), (("range", "range_weight"), self.range)):
            for k in names:
                m[AT[k], AT[k]] = (1 - 1 / MEAN_ROWS) ** int((~np.isnan(x)).sum())
        m[AT["kama"], AT["kama"]] = np.prod(1 - self.weight)
        return m, np.array([out[k][-1] for k in STATE])

    def begin(self) -> np.ndarray:
        """The state before a series' first row."""
        z = np.zeros(len(STATE))
        z[[*[AT[s] for s in EMA_SPANS], AT["kama"]]] = self.close[0]
        return z


class Levels:
    """A level that becomes the price wherever the price is at least the level and a distance: x >= level + d. For lows, x and d count
    down, that is, both are given as their negatives."""

    def __init__(self, x: np.ndarray, d: np.ndarray) -> None:
        self.x, self.d, self.pass_at = x, d, x - d
        self.size = max(1, int(np.sqrt(len(x))))
        k = -(-len(x) // self.size)
        self.blocks = np.pad(self.pass_at, (0, k * self.size - len(x)), constant_values=-np.inf).reshape(k, self.size)
        self.most = self.blocks.max(axis=1)

    def near(self, start: int, level: float) -> int:
        """The first row from start on whose price less its distance is at least the level, else -1."""
        b = start // self.size
        if b < len(self.blocks):
            hit = np.flatnonzero(self.blocks[b, start % self.size :] >= level)
            if len(hit):
                return start + int(hit[0])
            later = np.flatnonzero(self.most[b + 1 :] >= level)
            if len(later):
                b += 1 + int(later[0])
                return b * self.size + int(np.flatnonzero(self.blocks[b] >= level)[0])
        return -1

    def next(self, start: int, level: float) -> int:
        """The first row from start on at which the level moves, else -1. The sum decides, so that the last digit is that of the rule."""
        at = self.near(start, level - TINY * (1 + abs(level)))
        while at >= 0 and self.x[at] < level + self.d[at]:
            at = self.near(at + 1, level - TINY * (1 + abs(level)))
        return at

    def walk(self, level: float) -> list[int]:
        """All rows at which the level moves."""
        out, at = [], self.next(0, level)
        while at >= 0:
            out.append(at)
            at = self.next(at + 1, self.x[at])
        return out

    def map(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Price and distance of the rows that may be the first to move a level, in order, and for each the row whose price is the level at
        the end if it is the first. A level that none of them moves stays."""
        top = np.concatenate([[-np.inf], np.maximum.accumulate(self.pass_at)[:-1]])
        rows = np.flatnonzero(self.pass_at >= top - TINY * (1 + np.abs(np.where(np.isinf(top), 0.0, top))))
        x, d = self.x[rows], self.d[rows]
        rows = rows[np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])]
        last: dict[int, int] = {}

        def end(at: int) -> int:
            path = []
            while at not in last:
                path.append(at)
                to = self.next(at + 1, self.x[at])
                if to < 0:
                    last[at] = at
                    break
                at = to
            for p in path:
                last[p] = last[at]
            return last[at]

        return self.x[rows], self.d[rows], [end(int(r)) for r in rows]

    def follow(self, level: float, time: float, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The level and its time at every row."""
        moves = self.walk(level)
        at = np.searchsorted(np.asarray(moves, np.int64), np.arange(len(self.x)), side="right")
        return np.concatenate([[level], self.x[moves]])[at], np.concatenate([[time], seconds[moves]])[at]


def levels(s: Steps) -> dict[str, tuple[float, Levels]]:
    return {"high": (1.0, Levels(s.close, s.width)), "low": (-1.0, Levels(-s.close, s.width))}


def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: what a block does to the state, flat."""
    s = Steps(pdf)
    m, v = s.linear()
    row = {"block": [int(pdf["_b"].iat[0])], "first": [s.first], "close": [s.close[0]], "seconds": [s.seconds[0]], "m": [m.ravel()], "v": [v]}
    for name, (_, f) in levels(s).items():
        x, d, rows = f.map()
        row |= {f"{name}_x": [x], f"{name}_d": [d], f"{name}_to": [f.x[rows]], f"{name}_time": [s.seconds[rows]]}
    return pd.DataFrame(row)


MAP_SCHEMA = "block bigint, first bigint, close double, seconds double, m array<double>, v array<double>, " + ", ".join(f"{n}_{c} array<double>" for n in ("high", "low") for c in ("x", "d", "to", "time"))
STATE_SCHEMA = "block bigint, z array<double>, high double, high_at double, low double, low_at double"


def scan(maps: pd.DataFrame) -> pd.DataFrame:
    """The state that every block but a series' first begins with, from the maps of the blocks before it in order."""
    rows, z, level = [], None, {}
    for r in maps.sort_values("block").itertuples():
        if z is None:
            z = np.zeros(len(STATE))
            z[[*[AT[s] for s in EMA_SPANS], AT["kama"]]] = r.close
            level = {"high": (r.close, r.seconds), "low": (-r.close, r.seconds)}
        z = np.asarray(r.m).reshape(len(STATE), -1) @ z + np.asarray(r.v)
        for n in level:
            x, d, to, time = (np.asarray(getattr(r, f"{n}_{c}")) for c in ("x", "d", "to", "time"))
            hit = np.flatnonzero(x >= level[n][0] + d)
            if len(hit):
                level[n] = (float(to[hit[0]]), float(time[hit[0]]))
        rows.append((r.block + 1, z, level["high"][0], level["high"][1], -level["low"][0], level["low"][1]))
    return pd.DataFrame(rows, columns=["block", "z", "high", "high_at", "low", "low_at"])


def columns_of(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """All recursive columns of a block's own rows."""
    s = Steps(pdf)
    begins = s.first == 0
    z = s.begin() if begins else np.asarray(state["z"].iat[0])
    e = s.means(z)
    macd = e[12] - e[26]
    slope = np.diff(e[21], prepend=e[21][0] if begins else z[AT[21]])
    place = s.first + np.arange(s.n)
    with np.errstate(divide="ignore", invalid="ignore"):
        rs = (e["gain"] / e["weight"]) / np.where(e["loss"] == 0, np.nan, e["loss"] / e["weight"])
        rsi = 100 - 100 / (1 + rs)
        mean_range = e["range"] / e["range_weight"]
    rsi = np.where((place < MEAN_ROWS) | np.isnan(rsi), 50.0, rsi)
    if begins:
        known = mean_range[MEAN_ROWS - 1] if s.n >= MEAN_ROWS else 0.0
        mean_range = np.where(place < MEAN_ROWS - 1, known, mean_range)
    swing = {}
    for name, (sign, f) in levels(s).items():
        at = (s.close[0], s.seconds[0]) if begins else (state[name].iat[0], state[f"{name}_at"].iat[0])
        level, time = f.follow(sign * at[0], at[1], s.seconds)
        swing[name] = np.abs(s.close - sign * level), s.seconds - time
    values = [*[e[k] for k in EMA_SPANS], macd, e["signal"], macd - e["signal"], macd, e[50] - e[200], slope, np.where(s.close == 0, 0.0, np.abs(e[21] - e[55]) / np.where(s.close == 0, 1.0, s.close)), rsi, mean_range, e["kama"], swing["high"][0], swing["low"][0], swing["high"][1], swing["low"][1]]
    return pd.concat([s.rows, pd.DataFrame(dict(zip(FOLD_COLUMNS, values)), index=s.rows.index)], axis=1)


def with_folds(df: DataFrame, keys: tuple[str, ...] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """df (one bar for each key and ts; closes, highs and lows known) with every recursive column."""
    names = [f"`{n}` {t}" for n, t in df.dtypes]
    lines = haloed(placed(df, keys, ["ts"], rows), HALO, rows=rows)
    states = block_states(lines, keys, block_map, MAP_SCHEMA, scan, STATE_SCHEMA)
    schema = ", ".join([*names, *[f"{c} double" for c in FOLD_COLUMNS]])
    wanted = [*df.columns, *FOLD_COLUMNS]
    return lines.groupBy(*keys, "_b").cogroup(states.groupBy(*keys, "_b")).applyInPandas(lambda pdf, state: columns_of(pdf, state)[wanted], schema)
