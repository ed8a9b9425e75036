"""Window queries over hourly candles and the tick tape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import candles as K
from tidemark.operators.flow import filled_backward, filled_forward, with_flow
from tidemark.plans.registry import TICKS, query, rounded, with_candles
from tidemark.sources.tables import book, candles, trades

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _select(exprs: dict[str, str], digits: int, source: str = "c", key: str = "ts") -> str:
    return f"SELECT symbol, {key}, " + ", ".join(f"round({e}, {digits}) + 0.0 AS {k}" for k, e in exprs.items()) + f" FROM {source} {W}"


def bars(name: str, cols: Callable[[], dict[str, Column]], sql: dict[str, str], digits: int = 6) -> None:
    """A query over hourly candles whose columns need one window pass."""
    query(name, with_candles(_select(sql, digits)))(lambda spark, d: rounded(candles(spark, d).select("symbol", "ts", *[v.cast("double").alias(k) for k, v in cols().items()]), digits))


def steps(name: str, f: Callable[[DataFrame], DataFrame], out: str, inner: str, sql: str, digits: int = 6) -> None:
    """A query whose column needs a window over another window's result: `inner` adds column y to the candles."""
    query(name, with_candles(_select({out: sql}, digits, f"(SELECT *, {inner} AS y FROM c {W})")))(lambda spark, d: rounded(f(candles(spark, d)).select("symbol", "ts", F.col(out).cast("double").alias(out)), digits))


def tape(name: str, f: Callable[[DataFrame], DataFrame], out: str, sql: str, digits: int = 6, source: str = "t", more: str = "", of=trades) -> None:
    twin = f"WITH {TICKS}{more} SELECT symbol, trade_id, round({sql}, {digits}) + 0.0 AS {out} FROM {source} {W}"
    query(name, twin.replace("ORDER BY ts", "ORDER BY ts, trade_id"))(lambda spark, d: rounded(f(of(spark, d)).select("symbol", "trade_id", F.col(out).cast("double").alias(out)), digits))


LR = "ln(close / nullif(lag(close) OVER w, 0))"
for _p in (1, 3, 5, 15):
    bars("win_log_return" if _p == 1 else f"win_log_return_{_p}", lambda p=_p: {"logret": X.log_return(p=p)}, {"logret": f"ln(close / nullif(lag(close, {_p}) OVER w, 0))"}, 8)
bars("win_diff", lambda: {"diff": F.col("close") - X.lag("close")}, {"diff": "close - lag(close) OVER w"})
bars("win_pct_change", lambda: {"ret": X.pct_change()}, {"ret": "coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0)"}, 8)
bars("win_bollinger", X.bollinger, {
    "bb_mid": f"avg(close) {rows(20)}", "bb_upper": f"avg(close) {rows(20)} + 2 * stddev_samp(close) {rows(20)}", "bb_lower": f"avg(close) {rows(20)} - 2 * stddev_samp(close) {rows(20)}",
    "bb_width": f"4 * stddev_samp(close) {rows(20)} / nullif(avg(close) {rows(20)}, 0)",
})
bars("win_true_range", lambda: {"tr": X.true_range()}, {"tr": "greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0))"})
for _n in (15, 30, 60):
    steps("win_realized_vol" if _n == 60 else f"win_realized_vol_{_n}", lambda df, n=_n: X.with_realized_vol(df, n), f"realized_vol_{_n}", f"coalesce({LR}, 0)", f"coalesce(stddev_samp(y) {rows(_n)}, 0)", 8)
steps("win_rogers_satchell", X.with_rogers_satchell, "rsj", "ln(high / close) * ln(high / coalesce(lag(close) OVER w, close)) + ln(low / close) * ln(low / coalesce(lag(close) OVER w, close))", f"avg(y) {rows(14)}", 8)
for _x, _n in (("close", 50), ("close", 200), ("volume", 50)):
    bars(f"win_zscore_{_n}" if _x == "close" else f"win_zscore_{_x}_{_n}", lambda x=_x, n=_n: {"z": X.zscore(x, n)}, {"z": f"CASE WHEN stddev_samp({_x}) {rows(_n)} >= 1e-9 THEN ({_x} - avg({_x}) {rows(_n)}) / stddev_samp({_x}) {rows(_n)} ELSE 0 END"})
bars("win_bos", lambda: {k: v for n in (5, 15, 30) for k, v in X.break_of_structure(n).items()}, {
    f"bos_{d}_{n}": f"coalesce(CAST({c} {o} {f}({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS INTEGER), 0)" for n in (5, 15, 30) for d, c, o, f in (("up", "high", ">", "max"), ("down", "low", "<", "min"))
})
_UP, _DN = "coalesce(greatest(low - lag(high) OVER w, 0), 0)", "coalesce(greatest(lag(low) OVER w - high, 0), 0)"
bars("win_fvg", X.fair_value_gaps, {
    "fvg_up_width": _UP, "fvg_down_width": _DN,
    "fvg_up_fill": f"CASE WHEN {_UP} > 0 THEN least(greatest(1 - greatest(close - lag(high) OVER w, 0) / {_UP}, 0), 1) ELSE 0 END",
    "fvg_down_fill": f"CASE WHEN {_DN} > 0 THEN least(greatest(1 - greatest(lag(low) OVER w - close, 0) / {_DN}, 0), 1) ELSE 0 END",
})
_V = f"abs(y) / CASE WHEN count(y) {rows(30)} >= 5 AND stddev_samp(y) {rows(30)} >= 1e-9 THEN stddev_samp(y) {rows(30)} END"
steps("win_burst", X.with_burst, "burst_score", "coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0)", f"coalesce(CASE WHEN {_V} > 10 THEN 10 ELSE {_V} END, 0)")
bars("win_volume_z60", lambda: {"z": X.zscore("volume", 60, 5)}, {"z": f"CASE WHEN count(volume) {rows(60)} >= 5 AND stddev_samp(volume) {rows(60)} >= 1e-9 THEN (volume - avg(volume) {rows(60)}) / stddev_samp(volume) {rows(60)} ELSE 0 END"})
steps("win_atr_accel", X.with_range_acceleration, "atr_accel", f"avg(high - low) {rows(14)}", "coalesce(y - lag(y) OVER w, 0)")
steps("win_liquidity_proxy", X.liquidity_proxy, "liquidity_proxy", f"CASE WHEN count(volume) {rows(30)} >= 5 THEN avg(volume) {rows(30)} END", "coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)")
bars("win_fee_buffer", lambda: {"fee_buffer": X.fee_buffer()}, {"fee_buffer": f"0.0002 + quantile_cont(abs(high - low), 0.5) {rows(50)} / nullif(close, 0) / 2"}, 8)
bars("win_fee_buffer_mean", lambda: {"fee_buffer": X.fee_buffer(median=False)}, {"fee_buffer": f"0.0002 + avg(abs(high - low)) {rows(50)} / nullif(close, 0) / 2"}, 8)
bars("win_spread_median20", lambda: {"spread": X.rolling_median(F.col("high") - F.col("low"), 20)}, {"spread": f"quantile_cont(high - low, 0.5) {rows(20)}"})
bars("win_sma_range14", lambda: {"sma": X.sma(F.col("high") - F.col("low"), 14)}, {"sma": f"avg(high - low) {rows(14)}"})
bars("win_avg_volume50", lambda: {"avg_volume": X.sma("volume", 50)}, {"avg_volume": f"avg(volume) {rows(50)}"})
steps("win_rolling_volatility", lambda df: df.withColumn("_r", X.pct_change()).withColumn("vol", F.coalesce(X.deviation("_r", 20), F.lit(0.0))), "vol", "coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0)", f"coalesce(stddev_samp(y) {rows(20)}, 0)", 8)
bars("win_cummax", lambda: {"top": F.max("close").over(X.so_far())}, {"top": "max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"})
bars("win_drawdown", lambda: {"dd": X.drawdown("close")}, {"dd": "(close - max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) / nullif(max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)"})
bars("win_target_binary", lambda: {"target": X.target_binary()}, {"target": "coalesce(CAST(lead(close) OVER w > close AS INTEGER), 0)"})
steps("win_target", lambda df: df.withColumn("fee_buffer", X.fee_buffer()).withColumn("target", X.target(5)), "target", f"0.0002 + quantile_cont(abs(high - low), 0.5) {rows(50)} / nullif(close, 0) / 2", "CASE WHEN ln(lead(close, 5) OVER w) - ln(close) > y THEN 1 WHEN ln(lead(close, 5) OVER w) - ln(close) < -y THEN -1 ELSE 0 END")
bars("win_stream_features", lambda: {"ret": X.pct_change(), "momentum": F.coalesce(F.col("close") - X.lag("close"), F.lit(0.0)), "hl_range": F.col("high") - F.col("low")}, {"ret": "coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0)", "momentum": "coalesce(close - lag(close) OVER w, 0)", "hl_range": "high - low"})

_SPARSE = "CASE WHEN trades > 1 THEN close END"
steps("win_ffill", lambda df: filled_forward(df.withColumn("y", F.expr(_SPARSE)), "y"), "filled", _SPARSE, "last_value(y IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)")
steps("win_bfill", lambda df: filled_backward(df.withColumn("y", F.expr(_SPARSE)), "y"), "filled", _SPARSE, "first_value(y IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
_FILL5 = "last_value(y IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
query("win_fill_limit", with_candles("SELECT symbol, ts, round(coalesce(z, first_value(z IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)), 6) + 0.0 AS filled FROM z", more=f"y AS (SELECT *, {_SPARSE} AS y FROM c), z AS (SELECT *, {_FILL5} AS z FROM y)"))(
    lambda spark, d: rounded(X.fill_limited(candles(spark, d).withColumn("filled", F.expr(_SPARSE)), ["filled"]).select("symbol", "ts", "filled"))
)
query("filter_complete_rows", with_candles("SELECT symbol, ts, round(y2, 8) + 0.0 AS logret FROM (SELECT *, coalesce(z, first_value(z IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS y2 FROM z) WHERE y2 IS NOT NULL", more=f"y AS (SELECT *, ln(close / nullif(lag(close, 15) OVER w, 0)) AS y FROM c {W}), z AS (SELECT *, {_FILL5} AS z FROM y)"))(
    lambda spark, d: rounded(X.complete_rows(candles(spark, d).withColumn("logret", X.log_return(p=15)), ["logret"]).select("symbol", "ts", "logret"), 8)
)

tape("win_cvd", lambda df: with_flow(df, ["cvd"]), "cvd", "sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)")
tape("win_roll_impact", lambda df: with_flow(df, ["roll_impact"]), "roll_impact", f"avg(y) {rows(50)}", source="i", more=f", i AS (SELECT *, abs(price - lag(price) OVER w) / nullif(quantity, 0) AS y FROM t {W})")
tape("win_vpin", lambda df: with_flow(df, ["vpin"]), "vpin", f"sum(abs(quantity)) {rows(50)} / nullif(sum(quantity) {rows(50)}, 0)")
_BOOK = ", b AS (SELECT *, quantity AS bid_size, CAST(1 + user_id % 50 AS DOUBLE) AS ask_size, price - 0.05 AS bid_price, price + 0.05 AS ask_price FROM t)"
_D = lambda c: f"coalesce({c} - lag({c}) OVER w, 0)"
tape("win_ofi", lambda df: with_flow(df, ["ofi"]), "ofi", "sum(y) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)", source="s", of=book,
     more=f"{_BOOK}, s AS (SELECT *, CASE WHEN {_D('bid_price')} >= 0 THEN {_D('bid_size')} ELSE 0 END - CASE WHEN {_D('ask_price')} <= 0 THEN {_D('ask_size')} ELSE 0 END AS y FROM b {W})")
for _l in (1, 5, 10):
    tape("win_imbalance" if _l == 1 else f"win_imbalance_{_l}", lambda df, k=_l: df.withColumn("imbalance", X.imbalance(k)), "imbalance", f"coalesce((bid_size * {_l} - (ask_size + {_l})) / nullif(bid_size * {_l} + ask_size + {_l}, 0), 0)", source="b", of=book, more=_BOOK)
tape("win_microprice", lambda df: with_flow(df, ["microprice"]), "microprice", "(bid_price * ask_size + ask_price * bid_size) / nullif(bid_size + ask_size, 0)", 10, source="b", of=book, more=_BOOK)

query("win_gap_segments", with_candles(f"SELECT symbol, ts + INTERVAL 1 hour AS gap_start, n - INTERVAL 1 hour AS gap_end FROM (SELECT symbol, ts, lead(ts) OVER w AS n FROM f {W}) WHERE n > ts + INTERVAL 1 hour", more="""f AS (
  SELECT symbol, ts FROM c WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' UNION ALL
  SELECT DISTINCT symbol, unnest([TIMESTAMP '2024-01-02 23:00:00', TIMESTAMP '2024-01-20 01:00:00']) FROM c)"""))(lambda spark, d: K.gap_segments(candles(spark, d), 3600, "2024-01-03", "2024-01-20"))
query("win_gap_visible", with_candles(f"""SELECT symbol, p AS from_s, least((s - p) // 3600 - 1 + 2, 500) AS bars FROM (
  SELECT symbol, arg_min(p, p) AS p, arg_min(s, p) AS s FROM (SELECT symbol, epoch_us(ts) // 1000000 AS s, lag(epoch_us(ts) // 1000000) OVER w AS p FROM c WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' {W}) WHERE s - p >= 5400 GROUP BY symbol)"""))(
    lambda spark, d: K.first_visible_gap(candles(spark, d), 3600, "2024-01-03", "2024-01-20")
)
