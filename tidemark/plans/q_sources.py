"""Scans, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.functions.expressions import assignment, predicate
from tidemark.operators import candles as K
from tidemark.plans.q_aggregates import OHLCV, ohlcv
from tidemark.plans.registry import query, rounded, with_candles
from tidemark.session import scratch
from tidemark.sources.generators import offline_candles, offline_slice, random_walk
from tidemark.sources.tables import candles, table

query("flagship", with_candles("""SELECT symbol, ts, is_synthetic, round(close, 6) AS close, round(volume, 6) AS volume, round(m, 6) AS bb_mid, round(m + 2 * s, 6) AS bb_upper, round(z, 6) + 0.0 AS zscore_close_50, bos_up_5, target
FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS m, stddev_samp(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS s,
  CASE WHEN stddev_samp(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) >= 1e-9 THEN (close - avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)) / stddev_samp(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) ELSE 0 END AS z,
  coalesce(CAST(high > max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS bos_up_5,
  CASE WHEN ln(lead(close, 5) OVER w) - ln(close) > b THEN 1 WHEN ln(lead(close, 5) OVER w) - ln(close) < -b THEN -1 ELSE 0 END AS target
  FROM (SELECT *, 0.0002 + quantile_cont(abs(high - low), 0.5) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) / close / 2 AS b FROM f) WINDOW w AS (PARTITION BY symbol ORDER BY ts))""",
    more="""g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM c GROUP BY 1),
f0 AS (SELECT g.symbol, g.ts, c.open, c.high, c.low, c.close AS raw, coalesce(c.volume, 0) AS volume, c.close IS NULL AS is_synthetic, last_value(c.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS close FROM g LEFT JOIN c ON c.symbol = g.symbol AND c.ts = g.ts),
f AS (SELECT symbol, ts, coalesce(high, close) AS high, coalesce(low, close) AS low, close, volume, is_synthetic FROM f0)"""))(lambda spark, d: flagship(spark, d))  # fmt: skip


def flagship(spark: SparkSession, d: str) -> DataFrame:
    full = K.fill_gaps(candles(spark, d), 3600).withColumn("fee_buffer", X.fee_buffer())
    bb = X.bollinger()
    out = full.select("symbol", "ts", "is_synthetic", "close", "volume", bb["bb_mid"].alias("bb_mid"), bb["bb_upper"].alias("bb_upper"), X.zscore("close", 50).alias("zscore_close_50"), X.break_of_structure(5)["bos_up_5"].alias("bos_up_5"), X.target(5).alias("target"))
    return rounded(out)


@query("scan_parquet_candles", with_candles(f"SELECT {OHLCV} FROM c"))
def scan_parquet_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles from files whose time is text: unparsable times are dropped."""
    path = scratch(spark, "raw")
    c = candles(spark, d).withColumn("ts", F.col("ts").cast("string"))
    c.unionByName(c.limit(3).withColumn("ts", F.lit("broken"))).write.parquet(path)
    return ohlcv(spark.read.parquet(path).withColumn("ts", F.expr("try_cast(ts as timestamp_ntz)")).where("ts is not null"))


query("scan_range_forward", with_candles(f"SELECT {OHLCV} FROM c WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'"))(lambda spark, d: ohlcv(candles(spark, d).where("ts between timestamp_ntz'2024-01-05' and timestamp_ntz'2024-01-09'")))
query("filter_time_range", with_candles(f"SELECT {OHLCV} FROM c WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:00:00' AND TIMESTAMP '2024-01-06 03:00:00'"))(lambda spark, d: ohlcv(candles(spark, d).where("ts between timestamp_ntz'2024-01-05 03:00:00' and timestamp_ntz'2024-01-06 03:00:00'")))
query("filter_day", with_candles(f"SELECT {OHLCV} FROM c WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'"))(lambda spark, d: ohlcv(candles(spark, d).where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-06'")))
query("filter_future", with_candles(f"SELECT {OHLCV} FROM c WHERE epoch_ms(ts) <= 1705000000000 + 3600000"))(lambda spark, d: ohlcv(candles(spark, d).where(F.unix_millis(F.col("ts").cast("timestamp")) <= 1705000000000 + 3600000)))
query("filter_synthetic", with_candles("SELECT symbol, ts, round(close, 6) AS close FROM c"))(lambda spark, d: rounded(K.fill_gaps(candles(spark, d), 3600).where("not is_synthetic").drop("is_synthetic").select("symbol", "ts", "close")))
query("store_read", with_candles(f"SELECT * FROM (SELECT {OHLCV} FROM c WHERE symbol = 'view' ORDER BY ts LIMIT 200)"))(lambda spark, d: ohlcv(candles(spark, d).where("symbol = 'view'").orderBy("ts").limit(200)))


_GEN = """WITH g AS (SELECT *, base + sin(i / 12.0) * 120 AS o, base + cos((i + 0.5) / 9.0) * 110 AS c FROM (SELECT i, TIMESTAMP '2024-01-01' + INTERVAL 1 minute * i AS ts, 26000 + sin(i / 180.0) * 900 + cos(i / 55.0) * 320 AS base FROM (SELECT unnest(range(0, {n})) AS i)))
SELECT ts, round(o, 2) AS open, round(greatest(o, c) + abs(sin(i / 5.0)) * 60 + 25, 2) AS high, round(least(o, c) - (abs(cos(i / 7.0)) * 60 + 25), 2) AS low, round(c, 2) AS close, round(500 + abs(sin(i / 15.0)) * 220 + (i % 10) * 12, 3) AS volume FROM g"""
query("gen_offline_candles", _GEN.format(n=50000))(lambda spark, d: offline_candles(spark, 50000))
query("scan_offline_klines", f"SELECT * FROM ({_GEN.format(n=50000)}) WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-30' ORDER BY ts LIMIT 500")(lambda spark, d: offline_slice(offline_candles(spark, 50000), "2024-01-02", "2024-01-30", 500))
query("sim_random_walk")(lambda spark, d: random_walk(spark, 1000, 7))
_RAW = "CASE WHEN event_id % 50 = 7 THEN 'x' ELSE CAST(100 + value AS VARCHAR) END"


@query("proj_normalize_kline", "SELECT event_id AS ts_ms_utc, round(100 + value, 6) AS close, CASE WHEN event_id % 3 = 0 THEN event_id ELSE event_id + 59999 END AS close_time_ms_utc FROM events WHERE event_id % 50 <> 7")
def proj_normalize_kline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    price = F.when(F.col("event_id") % 50 == 7, "x").otherwise((100 + F.col("value")).cast("string"))
    raw = e.select(F.col("event_id").alias("open_time"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit("1").alias("volume"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") + 59999).alias("close_time"))
    return rounded(K.normalize_klines(raw).select("ts_ms_utc", "close", "close_time_ms_utc"))


query("proj_coerce_ohlcv", with_candles("SELECT symbol, ts, round(open, 6) AS open, round(close, 6) AS close, 0.0::DOUBLE AS volume FROM c"))(lambda spark, d: rounded(K.coerce_ohlcv(candles(spark, d).withColumn("open", F.col("open").cast("string")).drop("volume")).select("symbol", "ts", "open", "close", "volume")))
query("pred_policy_expr", with_candles("SELECT symbol, ts, close > open AND (high - low) / close > 0.01 AS a, FALSE AS b, abs(close - open) >= greatest(1, high - close) AS e FROM c"))(
    lambda spark, d: (lambda c: c.select("symbol", "ts", predicate("close > open and (high - low) / close > 0.01", c.columns).alias("a"), predicate("missing_feature > 1", c.columns).alias("b"), predicate("abs(close - open) >= max(1, features['high'] - close)", c.columns).alias("e")))(candles(spark, d))
)
query("proj_sizing_expr", with_candles("SELECT symbol, ts, round(least(100.0, volume * 0.5) / close, 8) AS size, 0.0::DOUBLE AS broken FROM c"))(
    lambda spark, d: (lambda c: rounded(c.select("symbol", "ts", assignment("size = min(100.0, volume * 0.5) / close", c.columns).alias("size"), assignment("size = __import__('os')", c.columns).alias("broken")), 8))(candles(spark, d))
)
query("proj_select_features", with_candles("SELECT symbol, ts, round(close, 6) AS close, 0.0::DOUBLE AS absent, round(coalesce(y, 0), 8) + 0.0 AS logret FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS y FROM c)"))(
    lambda spark, d: rounded(select_features(candles(spark, d).withColumn("logret", X.log_return()), ["close", "absent", "logret"]), 8)
)


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Keys and the named features in this order; those that are missing or null are 0."""
    return df.select("symbol", "ts", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) if n in df.columns else F.lit(0.0).alias(n) for n in names])


query("proj_candle_payload", with_candles("SELECT symbol, max(epoch_ms(ts)) AS last_ms, count(*) AS bars, max(epoch_ms(ts)) <= 1893456000000 AS in_past FROM c GROUP BY 1"))(
    lambda spark, d: candles(spark, d).groupBy("symbol").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms"), F.count("*").alias("bars")).withColumn("in_past", F.col("last_ms") <= 1893456000000)
)
_SYM = "upper(event_type) || CASE event_id % 3 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USD' ELSE 'BTC' END"
query("proj_ccxt_symbol", f"SELECT s AS symbol, CASE WHEN s LIKE '%USDT' THEN substr(s, 1, length(s) - 4) || '/USDT' WHEN s LIKE '%USDC' THEN substr(s, 1, length(s) - 4) || '/USDC' WHEN s LIKE '%USD' THEN substr(s, 1, length(s) - 3) || '/USD' ELSE substr(s, 1, length(s) - 3) || '/' || substr(s, length(s) - 2) END AS pair, count(*) AS n FROM (SELECT {_SYM} AS s FROM events) GROUP BY ALL")(
    lambda spark, d: table(spark, d, "events").select(F.expr(_SYM).alias("symbol")).select("symbol", F.regexp_replace("symbol", "^(.+?)(USDT|USDC|USD|.{3})$", "$1/$2").alias("pair")).groupBy("symbol", "pair").agg(F.count("*").alias("n"))
)
query("proj_format_reasoning", with_candles("SELECT symbol, ts, concat_ws(' | ', CASE WHEN close > open THEN 'trend:up' END, CASE WHEN trades > 2 THEN 'liquid:yes' END) AS reasoning FROM c"))(
    lambda spark, d: candles(spark, d).select("symbol", "ts", F.concat_ws(" | ", F.transform(F.filter(F.array(F.when(F.col("close") > F.col("open"), F.struct(F.lit("trend").alias("k"), F.lit("up").alias("v"))), F.when(F.col("trades") > 2, F.struct(F.lit("liquid").alias("k"), F.lit("yes").alias("v")))), lambda x: x.isNotNull()), lambda x: F.concat_ws(":", x["k"], x["v"]))).alias("reasoning"))
)

