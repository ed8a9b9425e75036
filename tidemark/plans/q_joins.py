"""Alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.plans.q_aggregates import REG, folder_digests, folder_sql, regimes
from tidemark.plans.registry import TICKS, candles_sql, query, rounded, with_candles
from tidemark.sources.tables import candles, predictions, table, trades

query("join_asof_backward", f"WITH {TICKS}, {candles_sql('4 hours')} SELECT t.symbol, t.trade_id, round(c.close, 6) AS close FROM t ASOF LEFT JOIN c ON t.symbol = c.symbol AND t.ts >= c.ts")(
    lambda spark, d: rounded(J.asof_backward(trades(spark, d), candles(spark, d, "4h"), ["close"]).select("symbol", "trade_id", "close"))
)


@query("join_asof_orderflow", with_candles("""SELECT symbol, ts, round(coalesce(last_value(cvd IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS cvd
  FROM (SELECT c.symbol, c.ts, v.cvd FROM c LEFT JOIN v ON v.symbol = c.symbol AND v.ts = c.ts)""", more="v AS (SELECT symbol, date_trunc('second', ts) AS ts, max(quantity) AS cvd FROM t GROUP BY 1, 2)", interval="1 minute"))
def join_asof_orderflow(spark: SparkSession, d: str) -> DataFrame:
    flow = trades(spark, d).groupBy("symbol", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("quantity").alias("cvd"))
    return rounded(J.exact_then_forward(candles(spark, d, "1m").select("symbol", "ts"), flow, ["cvd"]).select("symbol", "ts", "cvd"))


_AGG = ("open", "high", "low", "close", "volume", "hl_range")
query("join_floor_bucket", with_candles("SELECT symbol, ts, " + ", ".join(f"round(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS agg_4h_{c}" for c in _AGG) + " FROM (SELECT c.symbol, c.ts, h.open, h.high, h.low, h.close, h.volume, h.high - h.low AS hl_range FROM c LEFT JOIN h ON h.symbol = c.symbol AND h.ts = time_bucket(INTERVAL '4 hours', c.ts, TIMESTAMP '1970-01-01'))", more=candles_sql("4 hours", "h")))(
    lambda spark, d: rounded(J.floor_bucket(candles(spark, d).select("symbol", "ts"), candles(spark, d, "4h"), 14400, "4h"))
)
query("join_left_regime", with_candles("SELECT t.trade_id, g.regime FROM t LEFT JOIN g ON g.symbol = t.symbol AND g.ts = date_trunc('hour', t.ts)", more=REG))(
    lambda spark, d: trades(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")).join(regimes(spark, d).select("symbol", "ts", "regime"), ["symbol", "ts"], "left").select("trade_id", "regime")
)
query("join_index_align", with_candles("SELECT symbol, ts, round(close, 6) AS close FROM c SEMI JOIN (SELECT symbol, ts FROM c WHERE trades > 2) f USING (symbol, ts)"))(
    lambda spark, d: rounded(candles(spark, d).join(candles(spark, d).where("trades > 2").select("symbol", "ts"), ["symbol", "ts"], "left_semi").select("symbol", "ts", "close"))
)
query("join_predictions_map", with_candles("SELECT c.symbol, c.ts, round(p.up, 8) AS mark FROM c LEFT JOIN (SELECT symbol, ts, 1 / (1 + exp(-(close - open) / 10)) AS up FROM c WHERE trades > 1) p ON p.symbol = c.symbol AND p.ts = c.ts"))(
    lambda spark, d: rounded(candles(spark, d).select("symbol", "ts").join(predictions(spark, d).where("trades > 1").select("symbol", "ts", F.col("prob_up").alias("mark")), ["symbol", "ts"], "left"), 8)
)
query("join_hash_cdc", f"SELECT n.* FROM ({folder_sql()}) n ANTI JOIN ({folder_sql('WHERE doc_id % 97 <> 5')}) o USING (folder, digest)")(
    lambda spark, d: folder_digests(table(spark, d, "documents")).join(folder_digests(table(spark, d, "documents").where("doc_id % 97 <> 5")), ["folder", "digest"], "left_anti")
)
query("join_theta_range", with_candles("SELECT a.symbol, a.ts, count(*) AS near FROM c a JOIN c b ON a.symbol = b.symbol AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 3 hours GROUP BY ALL"))(lambda spark, d: range_count(candles(spark, d)))


def range_count(c: DataFrame, hours: int = 3) -> DataFrame:
    """Later bars within so many hours: a range join as an equi-join on hour buckets, each right row offered to the buckets that can reach it."""
    step = F.expr("interval 1 hour")
    right = c.select("symbol", F.col("ts").alias("b")).withColumn("k", F.explode(F.sequence(F.date_trunc("hour", "b").cast("timestamp_ntz") - step * hours, F.date_trunc("hour", "b").cast("timestamp_ntz"), step)))
    left = c.select("symbol", "ts", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("k"))
    return left.join(right, ["symbol", "k"]).where((F.col("b") > F.col("ts")) & (F.col("b") <= F.col("ts") + step * hours)).groupBy("symbol", "ts").agg(F.count("*").alias("near"))
