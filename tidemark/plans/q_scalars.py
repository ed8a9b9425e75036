"""Scalar functions, decisions as expressions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.functions import windows as X
from tidemark.functions.intervals import refresh_of, seconds_of
from tidemark.operators import backtest as B
from tidemark.operators import mlops as M
from tidemark.operators import policy as P
from tidemark.operators.search import Search
from tidemark.plans.registry import TICKS, query, rounded, with_candles
from tidemark.schema import INTERVALS
from tidemark.sources.tables import candles, predictions, table, trades

_TEXTS = ["1m", "5m", "1h", "4h", "1d", "90s", "15M", "2w", "", "x"]


def _intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in _TEXTS], "interval string")


_VALUES = ", ".join(f"('{t}')" for t in _TEXTS)
_SECONDS = f"""CASE {' '.join(f"WHEN lower(i) = '{k}' THEN {v}" for k, v in INTERVALS.items())} WHEN regexp_full_match(lower(i), '[0-9]+[smhd]') THEN greatest(1, CAST(regexp_extract(i, '[0-9]+') AS BIGINT)) * CASE right(lower(i), 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END ELSE 60 END"""
query("sc_interval_seconds", f"SELECT i AS interval, CAST({_SECONDS} AS BIGINT) AS seconds FROM (VALUES {_VALUES}) v(i)")(lambda spark, d: _intervals(spark).select("interval", seconds_of(F.col("interval")).alias("seconds")))
query("sc_refresh_seconds", f"SELECT i AS interval, round(least(greatest(1.0, {_SECONDS} / 12.0), 15.0), 6) AS seconds FROM (VALUES {_VALUES}) v(i)")(lambda spark, d: rounded(_intervals(spark).select("interval", refresh_of(F.col("interval")).alias("seconds"))))
query("sc_bars_required", "SELECT d AS days, least(greatest(d * 86400 // 60 + 5, 1000), 10000) AS bars FROM (SELECT unnest(range(0, 31)) AS d)")(lambda spark, d: spark.range(31).select(F.col("id").alias("days"), F.least(F.greatest(F.floor(F.col("id") * 86400 / 60) + 5, F.lit(1000)), F.lit(10000)).cast("bigint").alias("bars")))
query("sc_floor_bucket", f"WITH {TICKS} SELECT trade_id, epoch_us(ts) // 1000000 // 900 * 900 AS bucket FROM t")(lambda spark, d: trades(spark, d).select("trade_id", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 900) * 900).alias("bucket")))
query("sc_to_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.unix_millis(F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))).alias("ms")))
query("sc_unix", "SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")))
query("sc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")))
_MIN, _DAY = "2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440", "2 * pi() * (isodow(ts) - 1) / 7"
query("sc_cyclic_time", with_candles(f"SELECT symbol, ts, round(sin({_MIN}), 6) + 0.0 AS hour_sin, round(cos({_MIN}), 6) + 0.0 AS hour_cos, round(sin({_DAY}), 6) + 0.0 AS dow_sin, round(cos({_DAY}), 6) + 0.0 AS dow_cos FROM c"))(lambda spark, d: rounded(candles(spark, d).select("symbol", "ts", *[v.alias(k) for k, v in X.cyclic_time().items()])))
_SES = "CASE WHEN hour(ts) < 8 THEN 'Asia' WHEN hour(ts) < 16 THEN 'EU' ELSE 'US' END"
query("sc_session", with_candles(f"SELECT symbol, ts, {_SES} AS session FROM c"))(lambda spark, d: candles(spark, d).select("symbol", "ts", X.trading_session().alias("session")))
_BUCKET = "v AS (SELECT c.*, CASE WHEN close >= b THEN 'high' WHEN close <= a THEN 'low' ELSE 'med' END AS vol_bucket FROM c JOIN (SELECT symbol AS s, quantile_cont(close, 0.33) AS a, quantile_cont(close, 0.66) AS b FROM c GROUP BY 1) q ON q.s = c.symbol)"
query("sc_vol_bucket", with_candles("SELECT symbol, ts, vol_bucket FROM v", more=_BUCKET))(lambda spark, d: X.with_vol_bucket(candles(spark, d), "close").select("symbol", "ts", "vol_bucket"))
_HOT = ", ".join([f"CAST({_SES} = '{s}' AS DOUBLE) AS session_{s}" for s in ("Asia", "EU", "US")] + [f"CAST(vol_bucket = '{b}' AS DOUBLE) AS vol_bucket_{b}" for b in ("low", "med", "high")])


def _hot(spark: SparkSession, d: str) -> DataFrame:
    return X.with_vol_bucket(candles(spark, d), "close").withColumn("session", X.trading_session()).withColumns(X.one_hot())


query("sc_one_hot", with_candles(f"SELECT symbol, ts, {_HOT} FROM v", more=_BUCKET))(lambda spark, d: _hot(spark, d).select("symbol", "ts", *X.one_hot()))
query("sc_interactions", with_candles("SELECT symbol, ts, " + ", ".join(f"round((close - open) * CAST(vol_bucket = '{b}' AS DOUBLE), 6) + 0.0 AS move_x_{b}" for b in ("low", "med", "high")) + " FROM v", more=_BUCKET))(
    lambda spark, d: rounded(_hot(spark, d).withColumn("move", F.col("close") - F.col("open")).select("symbol", "ts", *[v.alias(k) for k, v in X.interactions(["move"]).items()]))
)
query("sc_onehot_to_label", with_candles("SELECT symbol, ts, vol_bucket AS label FROM v", more=_BUCKET))(
    lambda spark, d: _hot(spark, d).select("symbol", "ts", F.when(F.col("vol_bucket_high") > 0.5, "high").when(F.col("vol_bucket_med") > 0.5, "med").when(F.col("vol_bucket_low") > 0.5, "low").otherwise("med").alias("label"))
)
query("sc_log_volume", with_candles("SELECT symbol, ts, round(ln(1 + volume), 8) AS log_volume FROM c"))(lambda spark, d: rounded(candles(spark, d).select("symbol", "ts", F.log1p("volume").alias("log_volume")), 8))
query("sc_coalesce_vol", with_candles("SELECT symbol, ts, round(high - low, 6) + 0.0 AS vol FROM c"))(lambda spark, d: rounded(first_available(candles(spark, d).withColumn("atr", F.col("high") - F.col("low")), ["realized_vol_60", "vol_30", "atr"])))


def first_available(df: DataFrame, names: list[str]) -> DataFrame:
    """symbol, ts, vol: the first of the named columns that the frame has."""
    return df.select("symbol", "ts", next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("double")).alias("vol"))


query("sc_encode_target", "SELECT l_linenumber AS k, CASE l_linenumber - 2 WHEN -1 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS y, count(*) AS n FROM lineitem GROUP BY ALL")(
    lambda spark, d: table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), M.encode_target(F.col("l_linenumber") - 2).alias("y")).groupBy("k", "y").agg(F.count("*").alias("n"))
)
query("sc_execution_price", with_candles("SELECT symbol, ts, round(close + sign(close - open) * ((high - low) / 2 + 0.1 * (high - low)) + sign(close - open) * close * 0.0005, 6) AS price FROM c"))(
    lambda spark, d: rounded(candles(spark, d).select("symbol", "ts", B.execution_price(F.col("close"), F.signum(F.col("close") - F.col("open")), F.col("high") - F.col("low"), 0.1 * (F.col("high") - F.col("low")), F.col("close") * 0.0005).alias("price")))
)
UPS = "p AS (SELECT *, 1 / (1 + exp(-(close - open) / 10)) AS up FROM c)"
query("sc_kelly", with_candles("SELECT symbol, ts, round(least(abs(up - 0.5) / greatest(up * (1 - up), 1e-6), 0.5), 8) + 0.0 AS kelly FROM p", more=UPS))(lambda spark, d: rounded(predictions(spark, d).select("symbol", "ts", P.kelly(F.col("prob_up")).alias("kelly")), 8))
query("sc_delever", with_candles("SELECT symbol, ts, CASE WHEN (high - low) / high >= 0.10 THEN 0.5 WHEN (high - low) / high >= 0.05 THEN 0.75 ELSE 1.0 END::DOUBLE AS factor FROM c"))(lambda spark, d: candles(spark, d).select("symbol", "ts", P.delever((F.col("high") - F.col("low")) / F.col("high")).alias("factor")))
_EU = "SELECT symbol, ts, round(up * 1.5 * a - (1 - up) * a - 0.0012 * close, 6) + 0.0 AS eu_long, round((1 - up) * 1.5 * a - up * a - 0.0012 * close, 6) + 0.0 AS eu_short FROM (SELECT *, coalesce(nullif(high - low, 0), close * 0.004) AS a FROM p)"
query("sc_eu", with_candles(_EU, more=UPS))(lambda spark, d: rounded(predictions(spark, d).withColumn("atr", F.col("high") - F.col("low")).select("symbol", "ts", *[v.alias(k) for k, v in P.expected_utility().items()])))
query("sc_resolve_direction", with_candles("SELECT symbol, ts, CASE WHEN up >= 0.5 THEN 'up' ELSE 'down' END AS direction, round(greatest(up, 1 - up), 8) AS confidence, greatest(up, 1 - up) > 0.55 OR greatest(up, 1 - up) < 0.45 AS highlight FROM p", more=UPS))(
    lambda spark, d: rounded(predictions(spark, d).select("symbol", "ts", F.when(F.col("prob_up") >= F.col("prob_down"), "up").otherwise("down").alias("direction"), F.array_max(F.array("prob_down", "prob_flat", "prob_up")).alias("confidence"), (~F.col("pred_conf").between(0.45, 0.55)).alias("highlight")), 8)
)
query("sc_normalise_prediction", with_candles("SELECT symbol, ts, round(up, 8) AS p_up, round(1 - up, 8) AS p_down, round(greatest(up, 1 - up), 8) AS conf, round(greatest(greatest(up, 1 - up) - 0.1, 0), 8) AS ci_lo, round(least(greatest(up, 1 - up) + 0.1, 1), 8) AS ci_hi, 0.45::DOUBLE AS grey_lo, 0.55::DOUBLE AS grey_hi, 'med' AS bucket FROM p", more=UPS))(
    lambda spark, d: rounded(normalise(predictions(spark, d).select("symbol", "ts", "prob_up")), 8)
)


def normalise(df: DataFrame) -> DataFrame:
    """The full prediction of a scalar probability: both sides, confidence, interval of a tenth, default grey zone and bucket."""
    up = F.col("prob_up")
    conf = F.greatest(up, 1 - up)
    return df.select("symbol", "ts", up.alias("p_up"), (1 - up).alias("p_down"), conf.alias("conf"), F.greatest(conf - 0.1, F.lit(0.0)).alias("ci_lo"), F.least(conf + 0.1, F.lit(1.0)).alias("ci_hi"), F.lit(0.45).alias("grey_lo"), F.lit(0.55).alias("grey_hi"), F.lit("med").alias("bucket"))


_HASH = "list_transform(range(0, 64), lambda i: CAST(CAST('0x' || substr(h, 1 + 2 * CAST(i % 32 AS INTEGER), 2) AS INTEGER) AS DOUBLE))"
HASHED = f"SELECT {{id}} AS id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 8)) AS embedding FROM (SELECT {{id}}, {_HASH} AS v FROM (SELECT {{id}}, sha256({{text}}) AS h FROM {{table}}))"
query("sc_hash_embedding", "SELECT id, embedding[1] AS e1, embedding[33] AS e33, round(list_sum(embedding), 4) AS total FROM (" + HASHED.format(id="doc_id", text="text", table="documents") + ")")(
    lambda spark, d: rounded(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.transform(V.hash_embedding(F.col("text")), lambda x: F.round(x, 8)).alias("e")).select("id", F.col("e")[0].alias("e1"), F.col("e")[32].alias("e33"), F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("total")), 8).withColumn("total", F.round("total", 4))
)
query("sc_embed_model")(lambda spark, d: V.learned_embedding(table(spark, d, "documents"), "doc_id", "text"))


def neighbours(spark: SparkSession, d: str, k: int, by: str) -> DataFrame:
    """The k nearest of all rows for every row whose id is divisible by 20."""
    index = table(spark, d, "embeddings")
    return Search(index, by).top_k(index.where("vec_id % 20 = 0"), k).select(F.col("_query").alias("query_id"), F.col("_id").alias("vec_id"), "place", "score")


def neighbours_sql(k: int, by: str) -> str:
    score, order = (_L2, "ASC") if by == "l2" else (_COS, "DESC")
    return f"""SELECT query_id, vec_id, CAST(place AS INTEGER) AS place, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, vec_id) AS place
  FROM (SELECT query_id, vec_id, {score} AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e, (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0) q)) WHERE place <= {k}"""


_L2 = "list_sum(list_transform(range(1, 65), lambda i: pow(v[i] - q[i], 2)))"
_COS = "list_sum(list_transform(range(1, 65), lambda i: v[i] * q[i])) / ((sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8) * (sqrt(list_sum(list_transform(q, lambda x: x * x))) + 1e-8))"
query("vec_l2_topk", neighbours_sql(5, "l2"))(lambda spark, d: rounded(neighbours(spark, d, 5, "l2")))
query("vec_cosine_topk", neighbours_sql(5, "cosine"))(lambda spark, d: rounded(neighbours(spark, d, 5, "cosine")))
query("rag_search", f"SELECT k.query_id, k.vec_id, k.score, d.source AS folder, d.lang AS kind FROM ({neighbours_sql(3, 'cosine')}) k LEFT JOIN documents d ON d.doc_id = k.vec_id")(
    lambda spark, d: rounded(neighbours(spark, d, 3, "cosine").drop("place").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("folder"), F.col("lang").alias("kind")), "vec_id", "left"))
)
query("json_meta", "SELECT doc_id, source AS folder, n_chars FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.from_json(F.to_json(F.struct(F.col("source").alias("folder"), "n_chars")), "folder string, n_chars bigint").alias("m")).select("doc_id", "m.folder", "m.n_chars")
)
query("vec_add_persist", "SELECT vec_id, round(embedding[1], 6) AS first, len(embedding) AS dim FROM embeddings")(lambda spark, d: add_and_read(table(spark, d, "embeddings")))


def add_and_read(vectors: DataFrame) -> DataFrame:
    """Vectors appended in two writes and read back."""
    from tidemark.session import scratch

    path = scratch(vectors.sparkSession, "vectors")
    vectors.where("vec_id % 2 = 0").write.mode("append").parquet(path)
    vectors.where("vec_id % 2 = 1").write.mode("append").parquet(path)
    return vectors.sparkSession.read.parquet(path).select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").cast("bigint").alias("dim"))

