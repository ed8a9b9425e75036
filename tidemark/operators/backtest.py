"""Event-driven backtest of given sides, and performance metrics of equity curves and trades."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import BLOCK_ROWS, carried, haloed, in_block, placed

MINUTES_A_YEAR = 525600


@dataclass(frozen=True)
class Costs:
    """Fees in basis points (a maker's is paid with its sign turned), funding by bar, delay, fill, slippage by regime, balance."""

    taker_bp: float = 7.0
    maker_bp: float = -1.0
    funding_bp: float = 0.0
    latency_bars: int = 1
    max_fill: float = 1.0
    slip: tuple[tuple[str, float], ...] = (("low", 0.2), ("med", 0.4), ("high", 0.8))
    start: float = 10000.0


def execution_price(price: Column, direction: Column, spread: Column, slippage: Column, fee: Column) -> Column:
    """Price moved against the taker by half the spread and slippage, and by the fee."""
    return price + direction * (spread / 2 + slippage) + direction * fee


def backtest(rows: DataFrame, c: Costs = Costs(), block: int = BLOCK_ROWS) -> DataFrame:
    """Trades and equity of each symbol in one frame. rows: symbol, ts, high, low, close, volume, side, size, pred_conf, bucket.

    A bar's side takes effect latency_bars later, at that bar's close; the position is what it then becomes, so everything but the cash is
    a function of a few rows before. Cash is a running sum, and the open position's entry the last one so far: both are carried over blocks.
    """
    keys = ["symbol"]
    way = F.when(F.col("side") == "long", 1).when(F.col("side") == "short", -1).otherwise(0)
    base = rows.select("symbol", "ts", "close", "volume", (F.col("high") - F.col("low")).alias("_range"), way.alias("_way"), "size", "pred_conf", "bucket")
    # an entry looks 50 rows back, and what closes it needs the row before as it was
    df = haloed(placed(base, keys, ["ts"], block), 52 + c.latency_bars, rows=block)
    w = in_block(keys)
    lag = lambda x, n=1: F.lag(x, n).over(w)
    want, amount = (lag("_way", c.latency_bars), lag("size", c.latency_bars)) if c.latency_bars else (F.col("_way"), F.col("size"))
    df = df.withColumns({"_spread": F.percentile("_range", F.lit(0.5)).over(w.rowsBetween(-19, 0)), "_usual": F.avg("volume").over(w.rowsBetween(-49, 0)), "_want": F.coalesce(want, F.lit(0)), "_amount": amount})
    traded = F.when((F.col("_usual") > 0) & (F.col("volume") != 0), F.col("volume") / F.col("_usual")).otherwise(1.0)
    slip = F.coalesce(*[F.when(F.col("bucket") == k, v) for k, v in c.slip], F.lit(dict(c.slip)["med"]))
    away = F.col("_spread") / 2 + F.col("_spread") * slip * F.least(F.lit(1.0), F.abs("size") / F.greatest(F.coalesce(F.nullif(F.col("volume"), F.lit(0.0)), F.lit(1.0)), F.lit(1e-6)))
    fee = lambda taker: F.col("close") * F.when(taker, c.taker_bp).otherwise(-c.maker_bp) / 10000
    price = lambda d, taker: F.col("close") + d * away + d * fee(taker)
    df = df.withColumns({"_prev": F.coalesce(lag("_want"), F.lit(0)), "_size": F.when(F.col("_want") != 0, F.col("_amount") * F.least(F.lit(c.max_fill), F.lit(1.0), traded)).otherwise(0.0)})
    opens = (F.col("_want") != F.col("_prev")) & (F.col("_want") != 0)
    df = df.withColumn("_entry", F.when(opens, F.struct(price(F.col("_want"), F.abs(F.col("pred_conf") - 0.5) > 0.1).alias("price"), F.col("ts").alias("ts"))))
    df = df.withColumns({"_entry_before": lag("_entry"), "_size_before": lag("_size")}).where("_own")
    df = carried(df, keys, lasts={"_open": "_entry", "_held": "_entry_before"})
    closes = (F.col("_want") != F.col("_prev")) & (F.col("_prev") != 0)
    exit_ = price(-F.col("_prev"), F.lit(True))
    df = df.withColumns({"_exit": F.when(closes, exit_), "_pnl": F.when(closes, F.col("_prev") * (exit_ - F.col("_held.price")) * F.col("_size_before"))})
    df = df.withColumn("_flow", F.coalesce("_pnl", F.lit(0.0)) - F.when(F.col("_want") != 0, F.abs("_size") * F.col("close") * c.funding_bp / 10000).otherwise(0.0))
    df = carried(df, keys, sums={"_cash": "_flow"})
    equity = F.lit(c.start) + F.col("_cash") + F.when(F.col("_want") != 0, F.col("_want") * (F.col("close") - F.col("_open.price")) * F.col("_size")).otherwise(0.0)
    none = lambda t: F.lit(None).cast(t)
    named = lambda *xs: F.struct(*[x.alias(n) for n, x in zip(("kind", "entry_time", "side", "size", "entry_price", "exit_price", "pnl", "equity"), xs)])
    trade = named(F.lit("trade"), F.col("_held.ts"), F.when(F.col("_prev") > 0, "long").otherwise("short"), F.col("_size_before"), F.col("_held.price"), F.col("_exit"), F.col("_pnl"), none("double"))
    bar = named(F.lit("equity"), F.col("ts"), none("string"), *[none("double")] * 4, equity)
    made = df.select("symbol", "ts", F.explode(F.filter(F.array(F.when(closes, trade), bar), lambda x: x.isNotNull())).alias("o"))
    return made.select("symbol", "o.kind", "o.entry_time", F.col("ts").alias("exit_time"), "o.side", "o.size", "o.entry_price", "o.exit_price", "o.pnl", "o.equity")


def flip_pnl(rows: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Running pnl of unit positions that flip with the side (symbol, ts, close, side; ts distinct); flat closes."""
    keys = ["symbol"]
    df = haloed(placed(rows.select("symbol", "ts", "close", "side"), keys, ["ts"], block), 2, rows=block)
    lag = lambda x: F.lag(x).over(in_block(keys))
    df = df.withColumn("_prev", F.coalesce(lag("side"), F.lit("flat"))).withColumn("_entry", F.when(F.col("side") != F.col("_prev"), F.col("close")))
    df = carried(df.withColumn("_before", lag("_entry")).where("_own"), keys, lasts={"_held": "_before"})
    gain = F.when(F.col("_prev") == "long", F.col("close") - F.col("_held")).otherwise(F.col("_held") - F.col("close"))
    df = df.withColumn("_pnl", F.when((F.col("side") != F.col("_prev")) & (F.col("_prev") != "flat"), gain).otherwise(0.0))
    return carried(df, keys, sums={"pnl": "_pnl"}).select("symbol", "ts", "pnl")


def summary(equity: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """cagr, sharpe, sortino, max_drawdown, calmar, returns_vol, n of equity curves (ts, equity): one aggregation over one window pass."""
    w = Window.partitionBy(*keys).orderBy("ts")
    e = F.col("equity")
    ret = F.coalesce(e / F.nullif(F.lag("equity").over(w), F.lit(0.0)) - 1, F.lit(0.0))
    top = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = equity.withColumns({"_r": ret, "_d": (e - top) / F.nullif(top, F.lit(0.0))})
    a = df.groupBy(*keys).agg(F.min_by("equity", "ts").alias("f"), F.max_by("equity", "ts").alias("l"), F.count("*").alias("n"), F.avg("_r").alias("m"), F.stddev_samp("_r").alias("s"), F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("sd"), F.min("_d").alias("max_drawdown"))
    cagr = F.when((F.col("f") > 0) & (F.col("n") > 1), F.pow(F.col("l") / F.col("f"), F.lit(1.0) / (F.col("n") / MINUTES_A_YEAR)) - 1).otherwise(0.0)
    sharpe = F.when(F.col("s") > 0, F.sqrt("n") * F.col("m") / F.col("s")).otherwise(0.0)
    sortino = F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(F.when(F.col("m") > 0, float("inf")).otherwise(0.0))
    a = a.withColumns({"cagr": cagr, "sharpe": sharpe, "sortino": sortino})
    calmar = F.when(F.col("max_drawdown") != 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0)
    return a.select(*keys, "cagr", "sharpe", "sortino", "max_drawdown", calmar.alias("calmar"), F.coalesce("s", F.lit(0.0)).alias("returns_vol"), "n", F.col("l").alias("final_equity"))
