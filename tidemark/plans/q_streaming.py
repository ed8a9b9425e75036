"""Streams, drained over what the tables hold; bars have batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candles as K
from tidemark.operators import policy as P
from tidemark.plans.q_folds import DECISIONS, policy_sql
from tidemark.plans.registry import TICKS, query, rounded, with_candles
from tidemark.session import scratch
from tidemark.sources.tables import candles
from tidemark.streaming import candles as S

_BAR = "symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, trades"
#: The watermark is the newest tick of all; bars that end at or before it come out.
_CLOSED = "WHERE epoch_us(ts) + 3600000000 <= (SELECT epoch_ms(max(ts)) * 1000 FROM t)"
query("st_tumbling_candles", with_candles(f"SELECT {_BAR} FROM c {_CLOSED}"))(lambda spark, d: rounded(S.drain(S.tumbling_candles(S.tick_stream(spark, d), 3600), "bars").select("symbol", "ts", "open", "high", "low", "close", "volume", "trades")))
GAP_FILL = with_candles("""SELECT g.symbol, g.ts, round(coalesce(c.open, l), 6) AS open, round(coalesce(c.high, l), 6) AS high, round(coalesce(c.low, l), 6) AS low, round(l, 6) AS close, round(coalesce(c.volume, 0), 6) AS volume, c.close IS NULL AS is_synthetic
  FROM (SELECT g.*, last_value(c.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS l FROM g LEFT JOIN c ON c.symbol = g.symbol AND c.ts = g.ts) g LEFT JOIN c ON c.symbol = g.symbol AND c.ts = g.ts""", more="g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM c GROUP BY 1)")
query("st_gap_fill", GAP_FILL)(
    lambda spark, d: rounded(K.fill_gaps(candles(spark, d), 3600).select("symbol", "ts", "open", "high", "low", "close", "volume", "is_synthetic"))
)


def bar_stream(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "bars")
    candles(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume").write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


query("st_gap_fill_stream", GAP_FILL)(lambda spark, d: rounded(S.drain(S.fill_gaps_stream(bar_stream(spark, d), 3600), "filled")))
query("st_close_ready", with_candles("SELECT symbol, max(ts) AS last_closed FROM c " + _CLOSED + " GROUP BY 1"))(lambda spark, d: S.drain(S.tumbling_candles(S.tick_stream(spark, d), 3600), "closed").groupBy("symbol").agg(F.max("ts").alias("last_closed")))
query("st_next_candle", with_candles("SELECT symbol, ts, round(close, 6) AS close FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"))(lambda spark, d: rounded(K.newest(S.drain(bar_stream(spark, d), "poll"), 1).select("symbol", "ts", "close")))


@query("st_stream_state", with_candles("SELECT symbol, ts, round(close, 6) AS close FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 1200"))
def st_stream_state(spark: SparkSession, d: str) -> DataFrame:
    """Bars upserted by micro-batches; the newest version of each stays, 1200 a symbol at most."""
    folder = scratch(spark, "state")
    S.upsert_stream(bar_stream(spark, d), folder)
    rows = spark.read.parquet(folder)
    latest = rows.groupBy("symbol", "ts").agg(F.max_by("close", "_v").alias("close")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(K.newest(latest, 1200).select("symbol", "ts", "close"))


query("st_feature_buffer", with_candles("SELECT symbol, ts, round(close, 6) AS close FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 64"))(lambda spark, d: rounded(K.newest(S.drain(bar_stream(spark, d), "buffer"), 64).select("symbol", "ts", "close")))
query("st_live_decision", with_candles(DECISIONS, more=policy_sql("FALSE", "TRUE"), recursive=True))(lambda spark, d: rounded(P.apply_policy(predictions_of(S.drain(bar_stream(spark, d), "live")))))
query("stream_ws", f"WITH {TICKS} SELECT symbol, ts, price, quantity, is_buyer_maker FROM t")(lambda spark, d: S.drain(S.tick_stream(spark, d), "ticks").select("symbol", "ts", "price", "quantity", "is_buyer_maker"))
query("pipe_collect_live", with_candles("SELECT symbol, count(*) AS bars FROM c GROUP BY 1"))(lambda spark, d: S.drain(bar_stream(spark, d), "collect").groupBy("symbol").agg(F.count("*").alias("bars")))


def predictions_of(bars: DataFrame) -> DataFrame:
    up = 1 / (1 + F.exp(-(F.col("close") - F.col("open")) / 10))
    return bars.withColumns({"prob_up": up, "prob_down": 1 - up, "pred_conf": F.greatest(up, 1 - up)})


query("win_session", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(CAST(p IS NULL OR ts >= p + INTERVAL 6 hours AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, g")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
)
query("win_sliding", "SELECT event_type, s AS start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 hours, time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '1970-01-01'), INTERVAL 6 hours)) AS s FROM events) GROUP BY ALL")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").groupBy("event_type", F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
)
