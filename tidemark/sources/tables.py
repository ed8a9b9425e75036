"""Canonical views over the event, order and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.candles import trades_to_candles
from tidemark.schema import interval_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick tape: symbol, ts, price, quantity, is_buyer_maker, trade_id, user_id."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", (100 + F.col("value")).alias("price"), (1 + F.get_json_object("props", "$.k").cast("bigint")).cast("double").alias("quantity"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"), F.col("event_id").alias("trade_id"), "user_id",
    )


def candles(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    return trades_to_candles(trades(spark, sf_dir), interval_seconds(interval))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of book and depth levels 1, 5, 10, derived from the tape."""
    t = trades(spark, sf_dir).withColumns({"bid_size": F.col("quantity"), "ask_size": (1 + F.col("user_id") % 50).cast("double")})
    levels = {f"{s}_size_{k}": F.col(f"{s}_size") * k if s == "bid" else F.col("ask_size") + k for k in (1, 5, 10) for s in ("bid", "ask")}
    return t.withColumns({"bid_price": F.col("price") - 0.05, "ask_price": F.col("price") + 0.05} | levels)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic probabilities on hourly candles, with the candle's columns."""
    c = candles(spark, sf_dir)
    up = 1 / (1 + F.exp(-(F.col("close") - F.col("open")) / 10))
    return c.withColumns({"prob_up": up, "prob_down": 1 - up, "prob_flat": F.lit(0.0), "pred_conf": F.greatest(up, 1 - up)})


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles with a fixed side: long on rising bars, short on falling ones."""
    side = F.when(F.col("close") > F.col("open"), "long").when(F.col("close") < F.col("open"), "short").otherwise("flat")
    return predictions(spark, sf_dir).withColumn("side", side)
