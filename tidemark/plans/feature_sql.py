"""The feature matrix in SQL: one recursive pass carries the state of every fold, windows do the rest."""

from __future__ import annotations

from tidemark.operators.features import CROSS, IMPULSE, INDICATORS, ORDER_FLOW, STRUCTURE, TIME, TRENDS
from tidemark.plans.registry import with_candles
from tidemark.schema import SESSIONS, VOL_BUCKETS

SPANS = (12, 26, 50, 200, 21, 55)
_BY = "PARTITION BY symbol ORDER BY ts"
_TAPE = "PARTITION BY symbol ORDER BY ts, trade_id"


def _last(n: int, by: str = _BY) -> str:
    return f"OVER ({by} ROWS {n - 1} PRECEDING)"


def _z(x: str, n: int, least: int = 2) -> str:
    return f"CASE WHEN count({x}) {_last(n)} >= {least} AND stddev_samp({x}) {_last(n)} >= 1e-9 THEN ({x} - avg({x}) {_last(n)}) / stddev_samp({x}) {_last(n)} ELSE 0 END"


def _folds() -> str:
    """State by row: EMAs, signal of the MACD, adaptive mean, gains and losses, true range and their weights, swings."""
    emas = ", ".join(f"k.e{s} + {2.0 / (s + 1)!r} * (p.close - k.e{s}) AS e{s}" for s in SPANS)
    names = ", ".join(f"e{s}" for s in SPANS)
    keep = "(1 - 1 / 14.0::DOUBLE)"
    return f"""n AS (SELECT *, row_number() OVER ({_BY}) AS i, coalesce(lag(close) OVER ({_BY}), close) AS before, lag(close) OVER ({_BY}) AS prev, abs(close - lag(close) OVER ({_BY})) AS st, abs(close - lag(close, 10) OVER ({_BY})) AS ch FROM c),
p AS (SELECT *, greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr, 1.5 * avg(high - low) {_last(14)} AS reach, epoch_us(ts) / 1e6 AS sec,
  CASE WHEN ch IS NOT NULL AND sum(st) {_last(10)} > 0 THEN pow(ch / sum(st) {_last(10)} * (2 / 3.0::DOUBLE - 2 / 31.0::DOUBLE) + 2 / 31.0::DOUBLE, 2) ELSE 2 / 31.0::DOUBLE END AS adapt FROM n),
k(symbol, i, {names}, signal, kama, g, l, gd, w, wd, hi, hit, lo, lot) AS (
  SELECT symbol, i, {", ".join("close" for _ in SPANS)}, 0.0::DOUBLE, close, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, tr, 1.0::DOUBLE, close, sec, close, sec FROM p WHERE i = 1 UNION ALL
  SELECT symbol, i, {names}, signal + 0.2::DOUBLE * (e12 - e26 - signal), kama, g, l, gd, w, wd, hi, hit, lo, lot FROM (
    SELECT p.symbol, p.i, {emas}, k.signal, k.kama + p.adapt * (p.close - k.kama) AS kama, k.g * {keep} + greatest(p.close - p.prev, 0) AS g, k.l * {keep} + greatest(p.prev - p.close, 0) AS l, k.gd * {keep} + 1 AS gd, k.w * {keep} + p.tr AS w, k.wd * {keep} + 1 AS wd,
      CASE WHEN p.close >= k.hi + p.reach THEN p.close ELSE k.hi END AS hi, CASE WHEN p.close >= k.hi + p.reach THEN p.sec ELSE k.hit END AS hit, CASE WHEN p.close <= k.lo - p.reach THEN p.close ELSE k.lo END AS lo, CASE WHEN p.close <= k.lo - p.reach THEN p.sec ELSE k.lot END AS lot
    FROM k JOIN p ON p.symbol = k.symbol AND p.i = k.i + 1)),
first_atr AS (SELECT symbol AS s, w / wd AS y FROM k WHERE i = 14)"""


def _flow() -> str:
    b = "bid_price, bid_size, ask_price, ask_size"
    t = f"OVER ({_TAPE})"
    levels = ", ".join(f"coalesce((quantity * {n} - (ask_size + {n})) / nullif(quantity * {n} + ask_size + {n}, 0), 0) AS imbalance_{n}" for n in (1, 5, 10))
    return f"""b0 AS (SELECT symbol, ts, trade_id, price, quantity, is_buyer_maker, price - 0.05 AS bid_price, price + 0.05 AS ask_price, quantity AS bid_size, CAST(1 + user_id % 50 AS DOUBLE) AS ask_size FROM t),
b1 AS (SELECT *, CASE WHEN coalesce(bid_price - lag(bid_price) {t}, 0) >= 0 THEN coalesce(bid_size - lag(bid_size) {t}, 0) ELSE 0 END - CASE WHEN coalesce(ask_price - lag(ask_price) {t}, 0) <= 0 THEN coalesce(ask_size - lag(ask_size) {t}, 0) ELSE 0 END AS step,
  abs(price - lag(price) {t}) / nullif(quantity, 0) AS impact FROM b0),
b2 AS (SELECT symbol, ts, trade_id, sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) OVER ({_TAPE} ROWS UNBOUNDED PRECEDING) AS cvd, sum(step) OVER ({_TAPE} ROWS UNBOUNDED PRECEDING) AS ofi, (bid_price * ask_size + ask_price * bid_size) / (bid_size + ask_size) AS microprice,
  coalesce(avg(impact) {_last(50, _TAPE)}, 0) AS roll_impact, coalesce(sum(abs(quantity)) {_last(50, _TAPE)} / nullif(sum(quantity) {_last(50, _TAPE)}, 0), 0) AS vpin, {levels} FROM b1),
f AS (SELECT symbol AS fs, time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') AS ft, {", ".join(f"last({c} ORDER BY ts, trade_id DESC) AS {c}" for c in ORDER_FLOW)} FROM b2 GROUP BY 1, 2)"""


def feature_sql(horizons: tuple[int, ...] = (5, 15), fee_bp: float = 7.0) -> str:
    lr = lambda p: f"ln(close / nullif(lag(close, {p}) OVER ({_BY}), 0))"
    up, down = f"coalesce(greatest(low - lag(high) OVER ({_BY}), 0), 0)", f"coalesce(greatest(lag(low) OVER ({_BY}) - high, 0), 0)"
    sd20, mean20 = f"stddev_samp(close) {_last(20)}", f"avg(close) {_last(20)}"
    minute, day = "2 * 3.141592653589793 * (hour(ts) * 60 + minute(ts)) / 1440", "2 * 3.141592653589793 * (isodow(ts) - 1) / 7"
    cols = {f"logret_{p}": lr(p) for p in (1, 3, 5, 15)} | {f"ema_{s}": f"e{s}" for s in (12, 26, 50, 200)}
    cols |= {"kama": "kama", "macd": "e12 - e26", "macd_signal": "signal", "macd_hist": "e12 - e26 - signal", "rsi_14": "coalesce(CASE WHEN i >= 15 AND l <> 0 THEN 100 - 100 / (1 + (g / gd) / (l / gd)) END, 50)"}
    cols |= {"bb_upper": f"{mean20} + 2 * {sd20}", "bb_lower": f"{mean20} - 2 * {sd20}", "bb_width": f"4 * {sd20} / nullif({mean20}, 0)", "atr_14": "coalesce(CASE WHEN i >= 14 THEN w / wd END, y, 0)"}
    cols |= {f"realized_vol_{n}" if n != 30 else "vol_30": f"coalesce(stddev_samp(r) {_last(n)}, 0)" for n in (15, 60, 30)}
    cols |= {"rsj": f"avg(rs) {_last(14)}", "zscore_close_50": _z("close", 50), "zscore_close_200": _z("close", 200), "zscore_kama_50": _z("kama", 50), "trend_ema12_26": "e12 - e26", "trend_ema50_200": "e50 - e200", "log_volume": "ln(1 + volume)", "volume_zscore_50": _z("volume", 50)}
    cols |= {"hour_sin": f"sin({minute})", "hour_cos": f"cos({minute})", "dow_sin": f"sin({day})", "dow_cos": f"cos({day})"}
    cols |= {f"bos_{d}_{n}": f"CAST(coalesce({c} {o} {f}({c}) OVER ({_BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), FALSE) AS DOUBLE)" for n in (5, 15, 30) for d, c, o, f in (("up", "high", ">", "max"), ("down", "low", "<", "min"))}
    cols |= {"fvg_up_width": up, "fvg_down_width": down, "fvg_up_fill": f"CASE WHEN {up} > 0 THEN least(greatest(1 - greatest(close - lag(high) OVER ({_BY}), 0) / {up}, 0), 1) ELSE 0 END", "fvg_down_fill": f"CASE WHEN {down} > 0 THEN least(greatest(1 - greatest(lag(low) OVER ({_BY}) - close, 0) / {down}, 0), 1) ELSE 0 END"}
    cols |= {"swing_dist_high": "abs(close - hi)", "swing_dist_low": "abs(close - lo)", "swing_time_high": "sec - hit", "swing_time_low": "sec - lot"}
    sd30 = f"CASE WHEN count(pc) {_last(30)} >= 5 AND stddev_samp(pc) {_last(30)} >= 1e-9 THEN stddev_samp(pc) {_last(30)} END"
    cols |= {"burst_score": f"coalesce(CASE WHEN abs(pc) / ({sd30}) > 10 THEN 10 ELSE abs(pc) / ({sd30}) END, 0)", "volume_zscore": _z("volume", 60, 5), "atr_accel": f"coalesce(ma - lag(ma) OVER ({_BY}), 0)", "trend_slope": f"coalesce(e21 - lag(e21) OVER ({_BY}), 0)", "trend_adx_proxy": "abs(e21 - e55) / close", "liquidity_proxy": f"coalesce(last_value(mv IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING), 0)"}
    forward = lambda c: f"last_value({c} IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING)"
    cols |= {c: f"coalesce({forward(c)}, 0)" for c in ORDER_FLOW}
    cross = {f"agg_{h}_{c}": forward(f"{h_}_{c}") for h, h_ in (("4h", "h4"), ("1d", "d1")) for c in CROSS}
    hour = "CASE WHEN hour(ts) < 8 THEN 'Asia' WHEN hour(ts) < 16 THEN 'EU' ELSE 'US' END"
    names = [*INDICATORS, *ORDER_FLOW, *TIME, *STRUCTURE, *IMPULSE, *cross]
    hot = {f"session_{s}": f"CAST({hour} = '{s}' AS DOUBLE)" for s in SESSIONS} | {f"vol_bucket_{b}": f"CAST(regime_label = '{b}' AS DOUBLE)" for b in VOL_BUCKETS}
    inter = {f"{t}_x_{b}": f"coalesce({t}, 0) * CAST(regime_label = '{b}' AS DOUBLE)" for t in TRENDS for b in VOL_BUCKETS}
    every = [*names, *hot, *inter]
    high = lambda name, width: f"{name} AS (SELECT symbol AS {name}s, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS {name}t, arg_min(open, ts) AS {name}_open, max(high) AS {name}_high, min(low) AS {name}_low, arg_max(close, ts) AS {name}_close, sum(volume) AS {name}_volume, max(high) - min(low) AS {name}_hl_range FROM c GROUP BY 1, 2)"
    more = ", ".join([
        _folds(), _flow(), high("h4", "4 hours"), high("d1", "1 day"),
        f"m AS (SELECT p.*, k.* EXCLUDE (symbol, i), y, f.* EXCLUDE (fs, ft), h4.* EXCLUDE (h4s, h4t), d1.* EXCLUDE (d1s, d1t), coalesce({lr(1).replace('(PARTITION BY symbol ORDER BY ts)', '(PARTITION BY p.symbol ORDER BY p.ts)')}, 0) AS r, coalesce(close / nullif(prev, 0) - 1, 0) AS pc, ln(high / close) * ln(high / before) + ln(low / close) * ln(low / before) AS rs, avg(high - low) OVER (PARTITION BY p.symbol ORDER BY p.ts ROWS 13 PRECEDING) AS ma, CASE WHEN count(volume) OVER (PARTITION BY p.symbol ORDER BY p.ts ROWS 29 PRECEDING) >= 5 THEN avg(volume) OVER (PARTITION BY p.symbol ORDER BY p.ts ROWS 29 PRECEDING) END AS mv FROM p JOIN k ON k.symbol = p.symbol AND k.i = p.i LEFT JOIN first_atr ON s = p.symbol LEFT JOIN f ON fs = p.symbol AND ft = p.ts LEFT JOIN h4 ON h4s = p.symbol AND h4t = time_bucket(INTERVAL 4 hours, p.ts, TIMESTAMP '1970-01-01') LEFT JOIN d1 ON d1s = p.symbol AND d1t = time_bucket(INTERVAL 1 day, p.ts, TIMESTAMP '1970-01-01'))",
        f"x0 AS (SELECT symbol, ts, high AS _high, low AS _low, close AS _close, {', '.join(f'{e} AS {n}' for n, e in (cols | cross).items())} FROM m)",
        "q AS (SELECT symbol AS qs, quantile_cont(realized_vol_60, 0.33) AS qa, quantile_cont(realized_vol_60, 0.66) AS qb FROM x0 GROUP BY 1)",
        "x1 AS (SELECT *, CASE WHEN realized_vol_60 >= qb THEN 'high' WHEN realized_vol_60 <= qa THEN 'low' ELSE 'med' END AS regime_label FROM x0 JOIN q ON qs = symbol)",
        f"x2 AS (SELECT symbol, ts, _high, _low, _close, regime_label, {', '.join(names)}, {', '.join(f'{e} AS {n}' for n, e in (hot | inter).items())} FROM x1)",
        f"x3 AS (SELECT symbol, ts, _high, _low, _close, regime_label, {', '.join(f'last_value({n} IGNORE NULLS) OVER ({_BY} ROWS 5 PRECEDING) AS {n}' for n in every)} FROM x2)",
        f"x4 AS (SELECT symbol, ts, _high, _low, _close, regime_label, {', '.join(f'coalesce({n}, first_value({n} IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS {n}' for n in every)} FROM x3)",
        f"x5 AS (SELECT * FROM x4 WHERE {' AND '.join(f'{n} IS NOT NULL' for n in every)})",
        f"x6 AS (SELECT *, {fee_bp / 10000!r} + quantile_cont(abs(_high - _low), 0.5) {_last(50)} / nullif(_close, 0) / 2 AS fee_buffer FROM x5)",
    ])
    ahead = {f"target_h{h}": f"CASE WHEN ln(lead(_close, {h}) OVER ({_BY})) - ln(_close) > fee_buffer THEN 1 WHEN ln(lead(_close, {h}) OVER ({_BY})) - ln(_close) < -fee_buffer THEN -1 ELSE 0 END" for h in horizons}
    return with_candles(f"SELECT symbol, ts, round(_close, 6) AS close, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in [*every, 'fee_buffer'])}, regime_label, {', '.join(f'{e} AS {n}' for n, e in ahead.items())} FROM x6", more=more, recursive=True)
