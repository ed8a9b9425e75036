"""Candles: from ticks, resampled, on complete grids, merged and retained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOL = ("symbol",)


def bucket(ts: str, seconds: int):
    """Start of the epoch-aligned, left-closed bucket."""
    return F.window(ts, f"{seconds} seconds").start


def trade_order(trades: DataFrame):
    """What open and close go by: time, and among trades of one time the trade id, where there is one."""
    return F.struct("ts", "trade_id") if "trade_id" in trades.columns else F.col("ts")


def trades_to_candles(trades: DataFrame, seconds: int) -> DataFrame:
    """One bar for each symbol and bucket that has trades. Open and close follow event time and trade id; taker buys are those whose buyer isn't the maker."""
    taker = lambda x: F.sum(F.when(~F.col("is_buyer_maker"), x).otherwise(0.0))
    quote, at = F.col("price") * F.col("quantity"), trade_order(trades)
    out = trades.groupBy("symbol", bucket("ts", seconds).alias("ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"),
        F.sum(quote).alias("quote_volume"), F.count("*").alias("trades"), taker(F.col("quantity")).alias("taker_buy_volume"), taker(quote).alias("taker_buy_quote"),
    )
    return out.withColumn("close_time", F.col("ts") + F.expr(f"interval {seconds} seconds") - F.expr("interval 1 millisecond"))


def resample(candles: DataFrame, seconds: int, sums: tuple[str, ...] = ("volume",), limit: int | None = None, keys: tuple[str, ...] = SYMBOL) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volumes; empty buckets give none. `limit` keeps the newest."""
    out = candles.withColumn("_b", bucket("ts", seconds)).groupBy(*keys, F.col("_b").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), *[F.sum(c).alias(c) for c in sums], F.max_by("close_time", "ts").alias("close_time"),
    )
    return newest(out, limit, keys) if limit else out


def newest(df: DataFrame, n: int, keys: tuple[str, ...] = SYMBOL, ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def resample_many(candles: DataFrame, seconds: dict[str, int]) -> DataFrame:
    """All timeframes of one base in a single aggregation: each bar goes to its bucket of every timeframe."""
    frames = F.array(*[F.struct(F.lit(k).alias("interval"), F.lit(v).cast("bigint").alias("s")) for k, v in seconds.items()])
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = candles.withColumn("_f", F.explode(frames)).withColumn("interval", F.col("_f.interval"))
    start = F.timestamp_micros(F.floor(us / (F.col("_f.s") * 1000000)) * F.col("_f.s") * 1000000).cast("timestamp_ntz")
    return rows.withColumn("_b", start).groupBy("symbol", "interval", F.col("_b").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )


def count_ratio_buckets(candles: DataFrame, base: int, ratio: int) -> DataFrame:
    """Groups of exactly `ratio` bars by position, from the first bar that stands on the coarser grid; an incomplete tail is dropped."""
    w = Window.partitionBy("symbol").orderBy("ts")
    aligned = F.unix_seconds(F.col("ts").cast("timestamp")) % (base * ratio) == 0
    from_first = candles.withColumn("_a", F.max(aligned.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_a = 1")
    grouped = from_first.withColumn("_g", F.floor((F.row_number().over(w) - 1) / ratio)).groupBy("symbol", "_g").agg(
        F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("_c"),
    )
    return grouped.where(F.col("_c") == ratio).drop("_c", "_g")


def grid(candles: DataFrame, seconds: int) -> DataFrame:
    """Every bucket from each symbol's first bar to its last."""
    ends = candles.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("ts"))


def fill_gaps(candles: DataFrame, seconds: int) -> DataFrame:
    """A complete grid: missing bars are flat at the last close, have no volume and are marked synthetic."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    full = grid(candles, seconds).join(candles.select("symbol", "ts", "open", "high", "low", "close", "volume", "trades"), ["symbol", "ts"], "left")
    last = F.last("close", ignorenulls=True).over(w)
    new = F.col("close").isNull()
    flat = {c: F.coalesce(c, last) for c in ("open", "high", "low")}
    return full.select("symbol", "ts", *[v.alias(k) for k, v in flat.items()], last.alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("trades", F.lit(0)).alias("trades"), new.alias("is_synthetic"))


def missing_bars(candles: DataFrame, seconds: int) -> DataFrame:
    return grid(candles, seconds).join(candles.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def gap_segments(candles: DataFrame, seconds: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """(symbol, gap_start, gap_end) of every run of missing bars, head and tail of [start, end] included; adjacent runs are one by construction."""
    step = F.expr(f"interval {seconds} seconds")
    rows = candles.select("symbol", "ts")
    if start and end:
        lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        rows = rows.where(F.col("ts").between(lo, hi))
        fence = candles.select("symbol").distinct().select("symbol", F.explode(F.array(lo - step, hi + step)).alias("ts"))
        rows = rows.unionByName(fence)
    nxt = F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    gaps = rows.withColumn("_n", nxt).where(F.col("_n") > F.col("ts") + step)
    return gaps.select("symbol", (F.col("ts") + step).alias("gap_start"), (F.col("_n") - step).alias("gap_end"))


def first_visible_gap(candles: DataFrame, seconds: int, start: str, end: str, factor: float = 1.5, max_bars: int = 500, pad: int = 1) -> DataFrame:
    """The first gap of at least `factor` steps inside a visible range, padded and capped to so many bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = candles.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).select("symbol", secs.alias("s"), F.lag(secs).over(w).alias("p"))
    gaps = rows.where(F.col("s") - F.col("p") >= factor * seconds).groupBy("symbol").agg(F.min(F.struct("p", "s")).alias("g"))
    bars = F.least(F.floor((F.col("g.s") - F.col("g.p")) / seconds) - 1 + 2 * pad, F.lit(max_bars))
    return gaps.select("symbol", (F.col("g.p") + seconds - pad * seconds).alias("from_s"), bars.cast("bigint").alias("bars"))


def keep_last(parts: list[DataFrame], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The union of versions, oldest first; of rows with one key the one of the last version stays."""
    tagged = [p.withColumn("_v", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_v")


def upsert_retain(existing: DataFrame, incoming: DataFrame, max_bars: int, keys: tuple[str, ...] = SYMBOL) -> DataFrame:
    """Existing bars with incoming ones over them; invalid incoming bars are skipped, and the newest max_bars of a key stay."""
    valid = newest(incoming.where(" and ".join(f"{c} is not null" for c in ("ts", "open", "high", "low", "close"))), max_bars, keys)
    return newest(keep_last([existing, valid], (*keys, "ts")), max_bars, keys)


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that only one of two versions has; empty means that nothing need be written."""
    return new.exceptAll(old).unionByName(old.exceptAll(new))


def normalize_klines(raw: DataFrame) -> DataFrame:
    """Typed candles from raw klines: bad rows are skipped, a missing close time is the open time."""
    num = {c: F.expr(f"try_cast({c} as double)") for c in ("open", "high", "low", "close", "volume")}
    rows = raw.select("open_time", *[v.alias(k) for k, v in num.items()], F.coalesce("close_time", "open_time").alias("close_time_ms"))
    return rows.where("open_time is not null and open is not null and high is not null and low is not null and close is not null").select(
        F.col("open_time").alias("ts_ms_utc"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.col("close_time_ms").alias("close_time_ms_utc"),
        F.timestamp_millis("open_time").cast("timestamp_ntz").alias("ts"),
    )


def coerce_ohlcv(df: DataFrame) -> DataFrame:
    """All five columns as doubles; those that are missing are 0."""
    return df.withColumns({c: F.expr(f"try_cast({c} as double)") if c in df.columns else F.lit(0.0) for c in ("open", "high", "low", "close", "volume")})
