"""The feature matrix: indicators, order flow, time, structure, impulse, liquidity, regimes and interactions, then fills and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators.flow import with_flow
from tidemark.operators.folds import with_folds
from tidemark.operators.joins import exact_then_forward, floor_bucket

#: The columns of the matrix by group, in order.
INDICATORS = [
    "logret_1", "logret_3", "logret_5", "logret_15", "ema_12", "ema_26", "ema_50", "ema_200", "kama", "macd", "macd_signal", "macd_hist", "rsi_14", "bb_upper", "bb_lower", "bb_width", "atr_14",
    "realized_vol_15", "realized_vol_60", "vol_30", "rsj", "zscore_close_50", "zscore_close_200", "zscore_kama_50", "trend_ema12_26", "trend_ema50_200", "log_volume", "volume_zscore_50",
]
ORDER_FLOW = ["cvd", "ofi", "microprice", "roll_impact", "vpin", "imbalance_1", "imbalance_5", "imbalance_10"]
TIME = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
STRUCTURE = [*[f"bos_{d}_{n}" for n in (5, 15, 30) for d in ("up", "down")], "fvg_up_width", "fvg_down_width", "fvg_up_fill", "fvg_down_fill", "swing_dist_high", "swing_dist_low", "swing_time_high", "swing_time_low"]
IMPULSE = ["burst_score", "volume_zscore", "atr_accel", "trend_slope", "trend_adx_proxy", "liquidity_proxy"]
TRENDS = ["trend_ema12_26", "trend_ema50_200", "trend_slope", "trend_adx_proxy"]
CROSS = ("open", "high", "low", "close", "volume", "hl_range")


def order_flow(trades: DataFrame, book: DataFrame | None, seconds: int) -> DataFrame:
    """Order-flow columns of the tape and the book, the last values of each bucket, at the bucket's start: symbol, ts and ORDER_FLOW.

    Without a book the tape's rows carry it, and one sort serves both. Rows of one time follow each other by trade id; of those at a
    bucket's last time, the first has the bucket's values.
    """

    def last(df: DataFrame, cols: list[str]) -> DataFrame:
        return df.groupBy("symbol", F.window("ts", f"{seconds} seconds").start.alias("ts")).agg(*[F.max_by(c, F.struct("ts", -F.col("_i"))).alias(c) for c in cols])

    filled = lambda df: df.fillna(0.0, subset=["roll_impact", "vpin"])
    levels = lambda df: df.withColumns({f"imbalance_{k}": X.imbalance(k) for k in (1, 5, 10)})
    if book is None:
        flow = filled(with_flow(trades, ["cvd", "ofi", "microprice", "roll_impact", "vpin"], keep_place=True))
        return last(levels(flow), ORDER_FLOW).select("symbol", "ts", *ORDER_FLOW)
    tape = last(filled(with_flow(trades, ["cvd", "roll_impact", "vpin"], keep_place=True)), ["cvd", "roll_impact", "vpin"])
    depth = last(levels(with_flow(book, ["ofi", "microprice"], keep_place=True)), ["ofi", "microprice", "imbalance_1", "imbalance_5", "imbalance_10"])
    return tape.join(depth, ["symbol", "ts"], "full").select("symbol", "ts", *ORDER_FLOW)


def build_features(candles: DataFrame, higher: dict[str, tuple[DataFrame, int]] | None = None, horizons: tuple[int, ...] = (15,), fee_bp: float = 7.0, flow: DataFrame | None = None) -> DataFrame:
    """Keys, features, fee buffer, regime label and targets, one row per bar that is complete after fills of at most five rows.

    One shuffle by symbol serves every window and the one grouped fold; quantiles of regimes are a row per symbol, taken of the closes
    alone. `higher` has candles of coarser timeframes and their seconds by name, `flow` order-flow columns by symbol and ts. The cost
    buffer and the targets are taken over the rows that are left, so that a target's horizon counts rows of the matrix. Candles are read
    more than once: give them as a stored table.
    """
    if "is_synthetic" in candles.columns:
        candles = candles.where("not is_synthetic")
    df = with_folds(candles.select("symbol", "ts", "open", "high", "low", "close", "volume"))
    df = X.with_rogers_satchell(df)
    for n in (15, 30, 60):
        df = X.with_realized_vol(df, n)
    df = df.withColumnRenamed("realized_vol_30", "vol_30")
    df = X.liquidity_proxy(X.with_range_acceleration(X.with_burst(df)))
    cols = {f"logret_{p}": X.log_return(p=p) for p in (1, 3, 5, 15)} | X.bollinger() | X.fair_value_gaps() | X.cyclic_time()
    for n in (5, 15, 30):
        cols |= X.break_of_structure(n)
    cols |= {"zscore_close_50": X.zscore("close", 50), "zscore_close_200": X.zscore("close", 200), "zscore_kama_50": X.zscore("kama", 50), "volume_zscore_50": X.zscore("volume", 50), "volume_zscore": X.zscore("volume", 60, 5)}
    cols |= {"log_volume": F.log1p("volume"), "session": X.trading_session()}
    df = df.withColumns(cols)
    names = [*INDICATORS, *TIME, *STRUCTURE, *IMPULSE]
    if flow is not None:
        df = exact_then_forward(df, flow, ORDER_FLOW)
        names[len(INDICATORS) : len(INDICATORS)] = ORDER_FLOW
    for name, (high, seconds) in (higher or {}).items():
        df = floor_bucket(df, high, seconds, name)
        names += [f"agg_{name}_{c}" for c in CROSS]
    df = X.with_vol_bucket(df, of=X.with_realized_vol(candles.select("symbol", "ts", "close"), 60)).withColumns(X.one_hot())
    df = df.withColumns(X.interactions(TRENDS))
    names += [*X.one_hot(), *X.interactions(TRENDS)]
    df = X.complete_rows(df.withColumn("regime_label", F.col("vol_bucket")), names)
    df = df.withColumn("fee_buffer", X.fee_buffer(fee_bp))
    df = df.withColumns({f"target_h{h}": X.target(h) for h in horizons})
    return df.select("symbol", "ts", "close", *names, "fee_buffer", "regime_label", *[f"target_h{h}" for h in horizons])


def simple_features(candles: DataFrame) -> DataFrame:
    """The small set: close, return, momentum, volatility, volume, atr and a binary target."""
    df = with_folds(candles.select("symbol", "ts", "open", "high", "low", "close", "volume"))
    df = df.withColumns({"return": X.pct_change(), "momentum": F.coalesce(F.col("close") - X.lag("close"), F.lit(0.0))})
    return df.select("symbol", "ts", "close", "return", "momentum", F.coalesce(X.deviation("return", 20), F.lit(0.0)).alias("volatility"), "volume", F.col("atr_14").alias("atr"), X.target_binary().alias("target"))
