"""Pipelines: features, backfill, history coverage, ingestion, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import hash_embedding
from tidemark.operators import candles as K
from tidemark.operators import features as X
from tidemark.functions.digests import hexadecimal, merged
from tidemark.plans.q_aggregates import OHLCV, folder_parts, folder_sql, ohlcv
from tidemark.plans.q_folds import _ATR
from tidemark.plans.feature_sql import feature_sql
from tidemark.plans.registry import query, rounded, with_candles
from tidemark.session import scratch, stored
from tidemark.schema import OHLCV as OHLCV_NAMES
from tidemark.sources.tables import book, candles, table



def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All groups of features over hourly candles; 4h and 1d candles are made of the hourly ones, which the tape gives once."""
    base = stored(candles(spark, d).select("symbol", "ts", *OHLCV_NAMES, "close_time"), "hourly")
    higher = {name: (K.resample(base, seconds), seconds) for name, seconds in (("4h", 14400), ("1d", 86400))}
    return X.build_features(base, higher, (5, 15), flow=X.order_flow(book(spark, d), None, 3600))


query("pipe_build_features", feature_sql())(lambda spark, d: rounded(feature_matrix(spark, d)))
query("pipe_simple_features", with_candles("""SELECT n.symbol, n.ts, round(n.close, 6) AS close, round(n.r, 8) + 0.0 AS "return", round(n.m, 6) + 0.0 AS momentum, round(n.vol, 6) + 0.0 AS volatility, round(n.volume, 6) AS volume, round(coalesce(CASE WHEN n.i >= 14 THEN w.y / w.den END, f.y, 0), 6) AS atr, n.target
FROM (SELECT *, coalesce(stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), 0) AS vol FROM (SELECT *, coalesce(close / nullif(lag(close) OVER u, 0) - 1, 0) AS r, coalesce(close - lag(close) OVER u, 0) AS m, coalesce(CAST(lead(close) OVER u > close AS INTEGER), 0) AS target FROM n WINDOW u AS (PARTITION BY symbol ORDER BY ts))) n
JOIN w ON w.symbol = n.symbol AND w.i = n.i LEFT JOIN (SELECT symbol, y / den AS y FROM w WHERE i = 14) f ON f.symbol = n.symbol""", more=_ATR, recursive=True))(
    lambda spark, d: X.simple_features(candles(spark, d)).select("symbol", "ts", F.round("close", 6).alias("close"), (F.round("return", 8) + 0.0).alias("return"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("momentum", "volatility", "volume", "atr")], "target")
)
_HOLES = "h AS (SELECT * FROM c WHERE hour(ts) % 5 <> 2)"


@query("pipe_backfill_day", with_candles(f"SELECT {OHLCV} FROM c WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'"))
def pipe_backfill_day(spark: SparkSession, d: str) -> DataFrame:
    """A day whose stored bars have holes: missing grid bars are fetched, merged under the last version, and the day is cut out."""
    full = candles(spark, d)
    old = full.where("hour(ts) % 5 <> 2")
    missing = K.missing_bars(old, 3600)
    return ohlcv(K.keep_last([old, full.join(missing, ["symbol", "ts"], "left_semi")]).where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-11'"))


@query("pipe_history", with_candles(f"SELECT {OHLCV} FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 300"))
def pipe_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest 300 bars: cached bars up to a day, fetched ones after it, merged, kept, cut."""
    c = candles(spark, d)
    return ohlcv(K.upsert_retain(c.where("ts < timestamp_ntz'2024-01-25'"), c.where("ts >= timestamp_ntz'2024-01-24'"), 300))


query("pipe_fetch_gap", with_candles(f"SELECT {OHLCV} FROM c WHERE hour(ts) % 5 = 2 AND ts > (SELECT min(ts) FROM c) AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05'"))(lambda spark, d: fetch_gap(spark, d))


def fetch_gap(spark: SparkSession, d: str) -> DataFrame:
    """The source's bars that lie in gaps of the stored ones, within a range: gaps become hours, hours an equi-join."""
    full = candles(spark, d)
    stored_ = full.where("hour(ts) % 5 <> 2")
    gaps = K.gap_segments(stored_, 3600, "2024-01-03", "2024-01-05")
    hours = gaps.select("symbol", F.explode(F.sequence("gap_start", "gap_end", F.expr("interval 1 hour"))).alias("ts"))
    return ohlcv(full.join(hours, ["symbol", "ts"], "left_semi"))


@query("pipe_ensure_history", with_candles("SELECT symbol, count(*) FILTER (WHERE hour(ts) % 5 <> 2) AS had, count(*) FILTER (WHERE hour(ts) % 5 = 2 AND ts > a AND ts < b) AS fetched, count(*) FILTER (WHERE hour(ts) % 5 <> 2 OR (ts > a AND ts < b)) AS bars, min(ts) FILTER (WHERE hour(ts) % 5 <> 2) <= TIMESTAMP '2024-01-02' AS covered FROM c JOIN (SELECT symbol AS s, min(ts) FILTER (WHERE hour(ts) % 5 <> 2) AS a, max(ts) FILTER (WHERE hour(ts) % 5 <> 2) AS b FROM c GROUP BY 1) ON s = symbol GROUP BY 1"))
def pipe_ensure_history(spark: SparkSession, d: str) -> DataFrame:
    """Stored bars with holes are made complete from the source: what was there, what was fetched, and whether the look-back is covered."""
    full = candles(spark, d).select("symbol", "ts", "close")
    have = stored(full.where("hour(ts) % 5 <> 2"), "have")
    fetched = full.join(K.missing_bars(have, 3600), ["symbol", "ts"], "left_semi")
    both = stored(K.keep_last([have.withColumn("new", F.lit(False)), fetched.withColumn("new", F.lit(True))]), "both")
    return both.groupBy("symbol").agg(F.count_if(~F.col("new")).alias("had"), F.count_if("new").alias("fetched"), F.count("*").alias("bars"), (F.min("ts") <= F.lit("2024-01-02").cast("timestamp_ntz")).alias("covered"))


query("pipe_ensure_range", with_candles("SELECT g.symbol, count(*) AS expected, count(*) FILTER (WHERE c.ts IS NULL) AS missing FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM c GROUP BY 1) g LEFT JOIN c ON c.symbol = g.symbol AND c.ts = g.ts GROUP BY 1"))(
    lambda spark, d: K.grid(candles(spark, d), 3600).join(candles(spark, d).select("symbol", "ts", F.lit(1).alias("x")), ["symbol", "ts"], "left").groupBy("symbol").agg(F.count("*").alias("expected"), F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).alias("missing"))
)
query("pipe_preload", with_candles(f"SELECT {OHLCV} FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120", "4 hours"))(lambda spark, d: ohlcv(K.newest(K.resample(stored(candles(spark, d), "cache"), 14400), 120)))
_TITLED = "SELECT doc_id, source AS folder, 'doc ' || CAST(doc_id AS VARCHAR) AS title, sha256(text) AS digest FROM documents WHERE trim(text) <> ''"


@query("pipe_ingest", _TITLED)
def pipe_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text, embedded by hash and appended to the vector table; read back."""
    docs = table(spark, d, "documents").where("trim(text) <> ''")
    path = scratch(spark, "memory")
    docs.select("doc_id", F.col("source").alias("folder"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), hash_embedding(F.col("text"), 32).alias("embedding")).write.mode("append").parquet(path)
    return spark.read.parquet(path).drop("embedding")


query("table_ingest_registry", folder_sql())(
    # what the registry holds of the even half takes in the other half's lines: no line is read twice
    lambda spark, d: hexadecimal(merged([folder_parts(table(spark, d, "documents").where("doc_id % 2 = 0")), folder_parts(table(spark, d, "documents").where("doc_id % 2 <> 0"))], ["folder"]), ["folder"])
)
query("table_progress", "SELECT o_orderdate AS day, o_orderpriority AS tf, max(o_orderkey) AS last_key, count(*) AS n FROM orders GROUP BY ALL")(
    lambda spark, d: (lambda o: K.keep_last([o.where("o_orderkey % 2 = 0").groupBy(F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("tf")).agg(F.max("o_orderkey").alias("last_key"), F.count("*").alias("n")), o.groupBy(F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("tf")).agg(F.max("o_orderkey").alias("last_key"), F.count("*").alias("n"))], ("day", "tf")))(table(spark, d, "orders"))
)


@query("pipe_self_train_stage", with_candles("SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS rows, CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'first' ELSE 'second' END AS written FROM c GROUP BY ALL"))
def pipe_self_train_stage(spark: SparkSession, d: str) -> DataFrame:
    """A stage's cache by symbol and day: a later run writes the days that are not there, and reads the others."""
    path = scratch(spark, "stages")
    features = X.simple_features(candles(spark, d)).withColumn("day", F.to_date("ts"))
    features.where("day < date'2024-01-12'").withColumn("written", F.lit("first")).write.partitionBy("symbol", "day").parquet(path)
    there = spark.read.parquet(path).select("symbol", "day").distinct()
    features.join(there, ["symbol", "day"], "left_anti").withColumn("written", F.lit("second")).write.mode("append").partitionBy("symbol", "day").parquet(path)
    return spark.read.parquet(path).groupBy("symbol", "day", "written").agg(F.count("*").alias("rows"))


# what the reference lacks, from Spark
query("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda spark, d: table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")))
query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda spark, d: table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers")))
query("join_semi_anti", "SELECT c_mktsegment, count(*) FILTER (WHERE o.o_custkey IS NOT NULL) AS with_orders, count(*) FILTER (WHERE o.o_custkey IS NULL) AS without_orders FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c_custkey GROUP BY 1")(
    lambda spark, d: (lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("x", F.lit(1)).unionByName(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("x", F.lit(0))).groupBy("c_mktsegment").agg(F.sum("x").alias("with_orders"), F.sum(1 - F.col("x")).alias("without_orders")))(table(spark, d, "customer"), table(spark, d, "orders"))
)
