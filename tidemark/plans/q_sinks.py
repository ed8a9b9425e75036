"""Sinks and paged sources, each read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.functions import windows as X
from tidemark.operators import backtest as B
from tidemark.operators import candles as K
from tidemark.operators import features as Y
from tidemark.operators import mlops as M
from tidemark.plans.q_aggregates import EQ, equity
from tidemark.plans.q_folds import FREE, fixed
from tidemark.plans.q_ml import FEATURES, samples
from tidemark.plans.q_scalars import neighbours, neighbours_sql
from tidemark.plans.registry import query, rounded, with_candles
from tidemark.session import scratch
from tidemark.sources import sqlite
from tidemark.sources.clients import TRADE_FIELDS, offline_klines, offline_trades, paged_source
from tidemark.sources.tables import candles, table

_KLINES = """SELECT t * 60000 AS ts_ms_utc, round(b + cos((t + 0.5) / 9.0) * 110, 2) AS close FROM (SELECT t, 26000 + sin(t / 180.0) * 900 + cos(t / 55.0) * 320 AS b FROM (SELECT unnest(range({a}, {b})) AS t))"""


def source(spark: SparkSession, name: str, **options: int | str) -> DataFrame:
    """The paged source over the offline klines or trades."""
    cls = paged_source("klines", offline_klines()) if name == "klines" else paged_source("agg_trades", offline_trades(), TRADE_FIELDS)
    spark.dataSource.register(cls)
    return spark.read.format(name).options(**options).load()


def klines(spark: SparkSession, **options: int | str) -> DataFrame:
    return K.normalize_klines(source(spark, "klines", **options)).select("ts_ms_utc", F.round("close", 2).alias("close"))


_DAY = 86_400_000
query("scan_kline_rest", _KLINES.format(a=0, b=1000))(lambda spark, d: klines(spark, start_ms=0, end_ms=999 * 60000))
query("scan_kline_paginated", _KLINES.format(a=0, b=45000))(lambda spark, d: klines(spark, start_ms=0, end_ms=45000 * 60000 - 1))
query("scan_kline_backward", _KLINES.format(a=96001, b=100001))(lambda spark, d: klines(spark, end_ms=100000 * 60000, minimum=3500, mode="backward"))
query("scan_day_backward", _KLINES.format(a=1440, b=2880))(lambda spark, d: klines(spark, start_ms=_DAY, end_ms=2 * _DAY - 1, mode="backward"))
query("scan_agg_trades", "SELECT k * 250 AS trade_time, k AS trade_id, 26000 + k % 977 / 4 AS price, round(1 + k % 13 / 10, 1) AS quantity, k % 2 = 0 AS is_buyer_maker FROM (SELECT unnest(range(40, 5001)) AS k)")(
    lambda spark, d: source(spark, "agg_trades", start_ms=10_000, end_ms=1_250_000, chunk_ms=400_000).select("trade_time", "trade_id", F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"), "is_buyer_maker")
)


@query("sink_sqlite_append", with_candles("SELECT symbol, epoch_ms(ts) AS ms, round(close, 6) AS close FROM c"))
def sink_append(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to a database table in two writes, and read back in ranges of the time."""
    to = sqlite.database(spark, "appended")
    c = rounded(candles(spark, d).select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "close"))
    for part in ("ms % 7200000 = 0", "ms % 7200000 <> 0"):
        sqlite.append(c.where(part), to, "candles")
    return sqlite.scan(spark, to, "SELECT * FROM candles", "symbol string, ms bigint, close double", "ms", [1704715200000 + i * 648000000 for i in range(3)])


@query("sink_orders", with_candles("SELECT symbol, ts, CASE WHEN close > open THEN 'buy' ELSE 'sell' END AS side, 1.0::DOUBLE AS size FROM c WHERE close <> open"))
def sink_orders(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "orders")
    fixed(spark, d).where("side <> 'flat'").select("symbol", "ts", F.when(F.col("side") == "long", "buy").otherwise("sell").alias("side"), "size").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("sink_features", with_candles("SELECT symbol, count(*) AS n FROM c GROUP BY 1"))
def sink_features(spark: SparkSession, d: str) -> DataFrame:
    """Features by symbol in folders, with a sidecar of names; read back by partition."""
    path = scratch(spark, "features")
    f = Y.simple_features(candles(spark, d))
    f.write.partitionBy("symbol").parquet(f"{path}/data")
    spark.createDataFrame([(c, t) for c, t in f.dtypes], "name string, type string").coalesce(1).write.json(f"{path}/meta")
    assert spark.read.json(f"{path}/meta").where("name = 'target'").count() == 1
    return spark.read.parquet(f"{path}/data").groupBy("symbol").agg(F.count("*").alias("n"))


@query("sink_report", with_candles("SELECT symbol, round(arg_max(equity, ts), 4) AS final_equity, count(*) AS n FROM e GROUP BY 1", more=EQ))
def sink_report(spark: SparkSession, d: str) -> DataFrame:
    """Equity as CSV, trades as CSV, the summary as JSON; the summary is read back."""
    path = scratch(spark, "report")
    e = equity(spark, d)
    e.select("symbol", "ts", "equity").write.option("header", True).csv(f"{path}/equity")
    B.backtest(fixed(spark, d), FREE).where("kind = 'trade'").drop("kind").write.option("header", True).csv(f"{path}/trades")
    B.summary(e).write.json(f"{path}/summary")
    return spark.read.json(f"{path}/summary").select("symbol", F.round("final_equity", 4).alias("final_equity"), "n")


query("agg_readiness", with_candles("SELECT symbol, count(*) AS bars, count(*) >= 500 AS ready, max(epoch_ms(ts)) AS last_ms FROM c GROUP BY 1"))(
    lambda spark, d: candles(spark, d).groupBy("symbol").agg(F.count("*").alias("bars"), (F.count("*") >= 500).alias("ready"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms"))
)


def _z(x: str, n: int) -> str:
    o = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"round(CASE WHEN stddev_samp({x}) {o} >= 1e-9 THEN ({x} - avg({x}) {o}) / stddev_samp({x}) {o} ELSE 0 END, 6) + 0.0 AS z_{x}_{n}"


query("win_zscore", with_candles(f"SELECT symbol, ts, {_z('close', 50)}, {_z('close', 200)}, {_z('volume', 50)} FROM c"))(
    lambda spark, d: rounded(candles(spark, d).select("symbol", "ts", *[X.zscore(x, n).alias(f"z_{x}_{n}") for x, n in (("close", 50), ("close", 200), ("volume", 50))]))
)
query("topk_vector", neighbours_sql(3, "l2"))(lambda spark, d: rounded(neighbours(spark, d, 3, "l2")))


@query("ml_artifacts")
def ml_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """A model written with its feature list, read back and applied."""
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    path = scratch(spark, "model")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep").transform(samples(spark, d).fillna(0.0, subset=FEATURES).withColumn("y", M.encode_target(F.col("target")).cast("double")))
    RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=3, maxDepth=3, seed=7).fit(rows).write().save(path)
    return RandomForestClassificationModel.load(path).transform(rows).select("symbol", "ts", F.col("prediction").alias("y"))
