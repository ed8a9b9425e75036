"""Aggregations, limits, set operations and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.digests import digest_parts, hexadecimal
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import backtest as B
from tidemark.operators import candles as K
from tidemark.operators import mlops as M
from tidemark.plans.registry import TICKS, candles_sql, query, r, rounded, with_candles
from tidemark.schema import DERIVED, INTERVALS
from tidemark.schema import OHLCV as OHLCV_NAMES
from tidemark.session import scratch, stored
from tidemark.sources.tables import candles, predictions, table, trades

OHLCV = "symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume"
COLS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def ohlcv(df: DataFrame) -> DataFrame:
    return rounded(df.select(*COLS))


query("agg_trades_to_candles", with_candles(f"SELECT {OHLCV}, round(quote_volume, 4) AS quote_volume, trades, round(taker_buy_volume, 4) AS taker_buy_volume, round(taker_buy_quote, 4) AS taker_buy_quote, close_time FROM c"))(
    lambda spark, d: candles(spark, d).select("symbol", "ts", *[r(F.col(c)).alias(c) for c in OHLCV_NAMES], *[r(F.col(c), 4).alias(c) for c in ("quote_volume", "taker_buy_volume", "taker_buy_quote")], "trades", "close_time")
)


def _re(interval: str, extra: str = "", source: str = "c", sums: str = "") -> str:
    return f"SELECT symbol, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS ts, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, round(sum(volume), 6) AS volume{sums} FROM {source} GROUP BY 1, 2{extra}"


query("agg_resample_ohlcv", with_candles(_re("4 hours")))(lambda spark, d: ohlcv(K.resample(candles(spark, d), 14400)))
query("agg_resample_10m", with_candles(_re("10 minutes", sums=", sum(trades)::BIGINT AS trades, round(sum(quote_volume), 4) AS quote_volume"), "1 minute"))(
    lambda spark, d: rounded(K.resample(candles(spark, d, "1m"), 600, ("volume", "trades", "quote_volume")).select(*COLS, "trades", F.round("quote_volume", 4).alias("quote_volume")))
)
query("agg_count_ratio_buckets", with_candles("""SELECT symbol, min(ts) AS ts, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, round(sum(volume), 6) AS volume
  FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) // 4 AS g FROM a WHERE ok) GROUP BY symbol, g HAVING count(*) = 4""", more="a AS (SELECT *, max(CAST(epoch_us(ts) % 14400000000 = 0 AS INTEGER)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 AS ok FROM c)"))(
    lambda spark, d: ohlcv(K.count_ratio_buckets(candles(spark, d), 3600, 4))
)
query("agg_ohlc_history_multi_tf", with_candles(" UNION ALL ".join(f"SELECT '{i}' AS interval, * FROM ({_re(f'{INTERVALS[i]} seconds')})" for i in DERIVED), "1 minute"))(
    lambda spark, d: rounded(K.resample_many(candles(spark, d, "1m"), {i: INTERVALS[i] for i in DERIVED}).select("interval", *COLS))
)


def equity(spark: SparkSession, d: str) -> DataFrame:
    """Ten thousand plus the running sum of each bar's move."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return candles(spark, d).select("symbol", "ts", F.round(10000 + F.sum(F.col("close") - F.col("open")).over(w), 6).alias("equity"), (F.col("close") - F.col("open")).alias("pnl"))


EQ = "e AS (SELECT symbol, ts, round(10000 + sum(close - open) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS equity, close - open AS pnl FROM c)"
RET = f"""{EQ}, q AS (SELECT *, coalesce(equity / nullif(lag(equity) OVER w, 0) - 1, 0) AS r, (equity - max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS d FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s AS (SELECT symbol, count(*) AS n, arg_max(equity, ts) AS final_equity, stddev_samp(r) AS returns_vol, avg(r) AS m, stddev_samp(r) FILTER (WHERE r < 0) AS sd, min(d) AS max_drawdown, pow(arg_max(equity, ts) / arg_min(equity, ts), 1.0 / (count(*) / 525600.0)) - 1 AS cagr FROM q GROUP BY symbol)"""
#: name: (column, its value in SQL, digits, whether the logarithm of 1 + value is compared: growth a year of short series is huge)
METRICS = {
    "agg_returns_vol": ("returns_vol", "returns_vol", 8, False), "agg_cagr": ("cagr", "cagr", 6, True), "agg_sharpe": ("sharpe", "CASE WHEN returns_vol > 0 THEN sqrt(n) * m / returns_vol ELSE 0 END", 6, False),
    "agg_sortino": ("sortino", "CASE WHEN sd > 0 THEN m / sd ELSE CASE WHEN m > 0 THEN 'inf'::DOUBLE ELSE 0 END END", 6, False), "agg_max_drawdown": ("max_drawdown", "max_drawdown", 8, False),
    "agg_calmar": ("calmar", "CASE WHEN max_drawdown <> 0 THEN cagr / abs(max_drawdown) ELSE 0 END", 6, True),
}


def _metric(c: str, digits: int, log: bool) -> Column:
    return (F.round(F.ln(F.nullif(1 + F.col(c), F.lit(0.0))) if log else F.col(c), digits) + 0.0).alias(f"log_{c}" if log else c)


def _metric_sql(c: str, sql: str, digits: int, log: bool) -> str:
    return f"round(ln(nullif(1 + {sql}, 0)), {digits}) + 0.0 AS log_{c}" if log else f"round({sql}, {digits}) + 0.0 AS {c}"


for _name, _m in METRICS.items():
    query(_name, with_candles(f"SELECT symbol, {_metric_sql(*_m)} FROM s", more=RET))(lambda spark, d, m=_m: B.summary(equity(spark, d)).select("symbol", _metric(m[0], *m[2:])))
query("agg_summary", with_candles("SELECT symbol, " + ", ".join(_metric_sql(*m) for m in METRICS.values()) + ", n, round(final_equity, 4) AS final_equity FROM s", more=RET))(
    lambda spark, d: B.summary(equity(spark, d)).select("symbol", *[_metric(m[0], *m[2:]) for m in METRICS.values()], "n", F.round("final_equity", 4).alias("final_equity"))
)
query("agg_hit_rate", with_candles("SELECT symbol, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM e GROUP BY 1", more=EQ))(lambda spark, d: rounded(equity(spark, d).groupBy("symbol").agg(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("hit_rate")), 8))
query("agg_avg_trade", with_candles("SELECT symbol, round(avg(pnl), 6) + 0.0 AS avg_trade FROM e GROUP BY 1", more=EQ))(lambda spark, d: rounded(equity(spark, d).groupBy("symbol").agg(F.avg("pnl").alias("avg_trade"))))


@query("agg_risk_state", with_candles("SELECT e.symbol, round(sum(pnl) FILTER (WHERE CAST(ts AS DATE) = last), 6) + 0.0 AS day_pnl, round(arg_max(equity, ts), 6) AS last_equity, round(min(d), 8) AS max_drawdown FROM (SELECT *, d FROM q) e JOIN (SELECT symbol, CAST(max(ts) AS DATE) AS last FROM q GROUP BY 1) l ON l.symbol = e.symbol GROUP BY 1", more=RET))
def agg_risk_state(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.windows import drawdown

    e = equity(spark, d).withColumn("dd", drawdown("equity"))
    day = F.max(F.to_date("ts")).over(Window.partitionBy("symbol"))
    g = e.withColumn("last", day).groupBy("symbol").agg(F.sum(F.when(F.to_date("ts") == F.col("last"), F.col("pnl"))).alias("day_pnl"), F.max_by("equity", "ts").alias("last_equity"), F.min("dd").alias("max_drawdown"))
    return g.select("symbol", (F.round("day_pnl", 6) + 0.0).alias("day_pnl"), F.round("last_equity", 6).alias("last_equity"), F.round("max_drawdown", 8).alias("max_drawdown"))


REG = "g AS (SELECT symbol, ts, close, open, close - open AS pnl, CASE WHEN high - low >= q.b THEN 'high' WHEN high - low <= q.a THEN 'low' ELSE 'med' END AS regime FROM c JOIN (SELECT symbol AS s, quantile_cont(high - low, 0.33) AS a, quantile_cont(high - low, 0.66) AS b FROM c GROUP BY 1) q ON q.s = c.symbol)"


def regimes(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.windows import with_vol_bucket

    c = predictions(spark, d).withColumns({"hl": F.col("high") - F.col("low"), "pnl": F.col("close") - F.col("open")})
    return with_vol_bucket(c, "hl").withColumnRenamed("vol_bucket", "regime")


query("agg_per_regime", with_candles("SELECT regime, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 8) AS hit_rate, round(avg(pnl), 6) + 0.0 AS avg_trade, count(*) AS n FROM g GROUP BY 1", more=REG))(
    lambda spark, d: regimes(spark, d).groupBy("regime").agg(F.round(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), 8).alias("hit_rate"), (F.round(F.avg("pnl"), 6) + 0.0).alias("avg_trade"), F.count("*").alias("n"))
)
query("agg_quantile_33_66", with_candles("SELECT symbol, round(quantile_cont(close, 0.33), 6) AS q33, round(quantile_cont(close, 0.66), 6) AS q66 FROM c GROUP BY 1"))(
    lambda spark, d: exact_quantiles(candles(spark, d), "close", (0.33, 0.66), ["symbol"]).select("symbol", F.round(F.col("_q")[0], 6).alias("q33"), F.round(F.col("_q")[1], 6).alias("q66"))
)

#: Labelled predictions: truth is the next bar's direction, the score a deterministic pseudo-probability.
LAB = f"""{REG}, p AS (SELECT *, 1 / (1 + exp(-(close - open) / 10)) AS up, CASE WHEN coalesce(lead(close) OVER (PARTITION BY symbol ORDER BY ts), close) > close THEN 1 ELSE 0 END AS y FROM g),
l AS (SELECT *, greatest(up, 1 - up) AS conf, CASE WHEN up > 0.5 THEN 1 ELSE 0 END AS yhat FROM p)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts")
    df = regimes(spark, d).withColumn("y", F.when(F.coalesce(F.lead("close").over(w), F.col("close")) > F.col("close"), 1).otherwise(0))
    return df.withColumns({"up": F.col("prob_up"), "conf": F.col("pred_conf"), "yhat": F.when(F.col("prob_up") > 0.5, 1).otherwise(0)})


def _ece_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}round(sum(CASE WHEN b < 15 THEN abs(p - a) * n / t ELSE 0 END), 8) + 0.0 AS ece FROM (SELECT *, sum(n) OVER ({'PARTITION BY ' + keys if keys else ''}) AS t FROM (SELECT {k}floor(conf * 15) AS b, avg(conf) AS p, avg(CAST(y = yhat AS DOUBLE)) AS a, count(*) AS n FROM l GROUP BY ALL)) {'GROUP BY ' + keys if keys else ''}"


def _mcc_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 8) + 0.0 AS mcc FROM (SELECT {k}sum(CAST(y = 1 AND yhat = 1 AS DOUBLE)) AS tp, sum(CAST(y = 0 AND yhat = 0 AS DOUBLE)) AS tn, sum(CAST(y = 0 AND yhat = 1 AS DOUBLE)) AS fp, sum(CAST(y = 1 AND yhat = 0 AS DOUBLE)) AS fn FROM l {'GROUP BY ' + keys if keys else ''})"


def hit() -> Column:
    return F.col("y") == F.col("yhat")


query("agg_ece", with_candles(_ece_sql(), more=LAB))(lambda spark, d: rounded(M.ece(labelled(spark, d), "conf", hit()), 8))


@query("agg_classification", with_candles(f"SELECT *, (SELECT mcc FROM ({_mcc_sql()})) AS mcc FROM (SELECT round(avg(-ln(greatest(CASE WHEN y = 1 THEN up ELSE 1 - up END, 1e-15))), 6) AS logloss, round(avg(CAST(y = yhat AS DOUBLE)), 8) AS accuracy, round(avg(pow(up - y, 2) + pow(1 - up - (1 - y), 2)), 6) AS brier FROM l)", more=LAB))
def agg_classification(spark: SparkSession, d: str) -> DataFrame:
    df = labelled(spark, d)
    p = F.when(F.col("y") == 1, F.col("up")).otherwise(1 - F.col("up"))
    a = df.agg(F.round(F.avg(-F.ln(F.greatest(p, F.lit(1e-15)))), 6).alias("logloss"), F.round(F.avg(hit().cast("double")), 8).alias("accuracy"), F.round(F.avg(F.pow(F.col("up") - F.col("y"), 2) + F.pow(1 - F.col("up") - (1 - F.col("y")), 2)), 6).alias("brier"))
    return a.join(F.broadcast(rounded(M.mcc(df, "y", "yhat"), 8)))  # one row each


query("agg_per_regime_cls", with_candles(f"SELECT * FROM ({_ece_sql('regime')}) JOIN ({_mcc_sql('regime')}) USING (regime)", more=LAB))(
    lambda spark, d: rounded(M.ece(labelled(spark, d), "conf", hit(), keys=("regime",)).join(M.mcc(labelled(spark, d), "y", "yhat", keys=("regime",)), "regime"), 8)
)
query("agg_directional", with_candles("SELECT round(avg(CAST(y = yhat AS DOUBLE)), 8) AS accuracy, round(avg(CASE WHEN conf >= 0.55 THEN CAST(y = yhat AS DOUBLE) END), 8) AS hit_rate, round(avg(r) / nullif(stddev_pop(r), 0), 6) + 0.0 AS sharpe_proxy FROM (SELECT *, CASE WHEN yhat = 1 THEN pnl ELSE -pnl END AS r FROM l)", more=LAB))(
    lambda spark, d: labelled(spark, d).withColumn("r", F.when(F.col("yhat") == 1, F.col("pnl")).otherwise(-F.col("pnl"))).agg(
        F.round(F.avg(hit().cast("double")), 8).alias("accuracy"), F.round(F.avg(F.when(F.col("conf") >= 0.55, hit().cast("double"))), 8).alias("hit_rate"), (F.round(F.avg("r") / F.nullif(F.stddev_pop("r"), F.lit(0.0)), 6) + 0.0).alias("sharpe_proxy"))
)
query("agg_class_weights", with_candles("SELECT regime, round(t / (k * n), 8) AS weight FROM (SELECT regime, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM g GROUP BY 1)", more=REG))(lambda spark, d: rounded(M.class_weights(regimes(spark, d), "regime"), 8))
query("agg_weighted_metrics", with_candles("SELECT symbol, round(sum(m * greatest(1, n)) / sum(greatest(1, n)), 6) + 0.0 AS weighted FROM (SELECT symbol, CAST(ts AS DATE) AS day, avg(pnl) AS m, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1", more=REG))(
    lambda spark, d: regimes(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg("pnl").alias("m"), F.greatest(F.lit(1), F.count("*")).alias("n")).groupBy("symbol").agg((F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6) + 0.0).alias("weighted"))
)
query("agg_distinct_classes", with_candles("SELECT regime, dense_rank() OVER (ORDER BY regime) - 1 AS code FROM (SELECT DISTINCT regime FROM g)", more=REG))(
    lambda spark, d: regimes(spark, d).select("regime").distinct().select("regime", (F.dense_rank().over(Window.orderBy("regime")) - 1).cast("bigint").alias("code"))  # a row per class
)
query("agg_cache_counts", with_candles("SELECT symbol, count(*) AS bars, count(*) > 0 AS ready, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY 1"))(
    lambda spark, d: candles(spark, d).groupBy("symbol").agg(F.count("*").alias("bars"), (F.count("*") > 0).alias("ready"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
)
def folder_sql(where: str = "") -> str:
    limbs = " || ".join(f"lpad(lower(to_hex(CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) % 4294967296 AS BIGINT))), 8, '0')" for i in range(8))
    return f"SELECT folder, {limbs} AS digest FROM (SELECT source AS folder, sha256(CAST(doc_id AS VARCHAR) || ':0:' || CAST(n_chars AS VARCHAR)) AS h FROM documents {where}) GROUP BY 1"


query("agg_folder_hash", folder_sql())(lambda spark, d: folder_digests(table(spark, d, "documents")))


def folder_parts(docs: DataFrame) -> DataFrame:
    """Parts of the digest of each folder's `path:mtime:size` lines, which can be merged."""
    return digest_parts(docs, {"folder": F.col("source")}, F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("0"), F.col("n_chars").cast("string")))


def folder_digests(docs: DataFrame) -> DataFrame:
    """A digest of each folder's lines whatever their order: sums of hashes, so a folder's files never meet as a list."""
    return hexadecimal(folder_parts(docs), ["folder"])


# limits and set operations
query("sort_ts", with_candles(f"SELECT {OHLCV} FROM c ORDER BY ts, symbol"))(lambda spark, d: ohlcv(candles(spark, d)).orderBy("ts", "symbol"))
query("topk_newest", with_candles(f"SELECT {OHLCV} FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50"))(lambda spark, d: ohlcv(K.newest(candles(spark, d), 50)))
_OLD, _NEW = "ts < TIMESTAMP '2024-01-20'", "ts >= TIMESTAMP '2024-01-10'"
_KEEP = f"k AS (SELECT *, 0 AS v FROM c WHERE {_OLD} UNION ALL SELECT symbol, ts, open, high, low, close + 1 AS close, volume, quote_volume, trades, taker_buy_volume, taker_buy_quote, close_time, 1 FROM c WHERE {_NEW})"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = candles(spark, d)
    return c.where(_OLD), c.where(_NEW).withColumn("close", F.col("close") + 1)


query("set_union_keep_last", with_candles(f"SELECT {OHLCV} FROM k QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY v DESC) = 1", more=_KEEP))(lambda spark, d: ohlcv(K.keep_last(list(_versions(spark, d)))))
query("dedup_by_time", f"WITH {TICKS} SELECT symbol, date_trunc('hour', ts) AS hour, min(trade_id) AS place, round(arg_max(price, trade_id), 6) AS price FROM t GROUP BY 1, 2")(
    lambda spark, d: rounded(trades(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min("trade_id").alias("place"), F.max_by("price", "trade_id").alias("price")))
)


@query("join_dict_upsert", with_candles(f"SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.ts, o.ts) AS ts, round(coalesce(n.close + 1, o.close), 6) AS close, CASE WHEN n.ts IS NULL THEN 'old' WHEN o.ts IS NULL THEN 'new' ELSE 'replaced' END AS how FROM (SELECT * FROM c WHERE {_OLD}) o FULL JOIN (SELECT * FROM c WHERE {_NEW}) n ON n.symbol = o.symbol AND n.ts = o.ts"))
def join_dict_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a history, by time: new entries win, and it is told where each came from."""
    old, new = (x.select("symbol", "ts", F.col("close").alias(n)) for x, n in zip(_versions(spark, d), ("was", "is")))
    both = old.join(new, ["symbol", "ts"], "full")
    how = F.when(F.col("is").isNull(), "old").when(F.col("was").isNull(), "new").otherwise("replaced")
    return rounded(both.select("symbol", "ts", F.coalesce("is", "was").alias("close"), how.alias("how")))


query("set_distinct_rows", with_candles(f"SELECT {OHLCV} FROM (SELECT symbol, ts, open, high, low, close, volume FROM c UNION SELECT symbol, ts, open, high, low, close, volume FROM c)"))(lambda spark, d: ohlcv(candles(spark, d).unionByName(candles(spark, d)).select(*COLS).dropDuplicates()))
_GRID = "g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM c GROUP BY 1)"
query("set_except_grid", with_candles("SELECT symbol, ts FROM g EXCEPT ALL SELECT symbol, ts FROM c", more=_GRID))(lambda spark, d: K.grid(candles(spark, d), 3600).exceptAll(candles(spark, d).select("symbol", "ts")))
query("join_anti_missing", with_candles("SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS missing FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.symbol = g.symbol AND c.ts = g.ts) GROUP BY ALL", more=_GRID))(lambda spark, d: K.missing_bars(candles(spark, d), 3600).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("missing")))
query("set_intersect", with_candles("SELECT symbol, ts FROM g INTERSECT SELECT symbol, ts FROM c", more=_GRID))(lambda spark, d: K.grid(candles(spark, d), 3600).intersect(candles(spark, d).select("symbol", "ts")))
query("set_union_versions", "SELECT DISTINCT p_brand AS version FROM part UNION SELECT DISTINCT p_type FROM part")(lambda spark, d: table(spark, d, "part").select(F.col("p_brand").alias("version")).union(table(spark, d, "part").select("p_type")).distinct())
query("sort_history", "SELECT o_orderdate AS day, o_orderpriority AS tf, o_orderstatus AS stage, count(*) AS n FROM orders GROUP BY ALL ORDER BY 1, 2, 3")(
    lambda spark, d: table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("tf"), F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("n")).orderBy("day", "tf", "stage")
)
query("topk_active_model", "SELECT p_brand AS model_type, p_size AS horizon, max(p_name) AS version FROM part GROUP BY ALL")(lambda spark, d: table(spark, d, "part").groupBy(F.col("p_brand").alias("model_type"), F.col("p_size").alias("horizon")).agg(F.max("p_name").alias("version")))

# sinks, read back
query("sink_parquet", with_candles(f"SELECT {OHLCV} FROM c"))(lambda spark, d: stored(ohlcv(candles(spark, d)), "sink"))


@query("sink_append_dedup", with_candles(f"SELECT DISTINCT {OHLCV} FROM (SELECT * FROM c WHERE {_OLD} UNION ALL SELECT * FROM c WHERE {_NEW})"))
def sink_append_dedup(spark: SparkSession, d: str) -> DataFrame:
    old = stored(ohlcv(candles(spark, d).where(_OLD)), "old")
    return stored(old.unionByName(ohlcv(candles(spark, d).where(_NEW))).dropDuplicates(), "appended")


_UP = f"n AS (SELECT *, 1 AS v FROM c WHERE {_NEW} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100), u AS (SELECT * FROM (SELECT *, 0 AS v FROM c WHERE {_OLD} UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY v DESC) = 1)"
query("sink_upsert_retention", with_candles(f"SELECT {OHLCV} FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100", more=_UP))(lambda spark, d: ohlcv(stored(K.upsert_retain(candles(spark, d).where(_OLD), candles(spark, d).where(_NEW), 100), "upsert")))


@query("sink_idempotent_parquet", with_candles("SELECT symbol, ts, round(close, 6) AS close FROM (SELECT symbol, ts, close FROM c WHERE ts >= TIMESTAMP '2024-01-20')"))
def sink_idempotent_parquet(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a second write would change: those after the first version's end."""
    c = rounded(candles(spark, d).select("symbol", "ts", "close"))
    return K.changed(c, stored(c.where(_OLD), "first"))


query("sink_append_history", f"WITH {TICKS}, {candles_sql('1 day')} SELECT {OHLCV} FROM c")(lambda spark, d: read_history(spark, d))


def read_history(spark: SparkSession, d: str) -> DataFrame:
    """Daily candles written by symbol and read back: the partition column is pruned by filters."""
    path = scratch(spark, "history")
    ohlcv(candles(spark, d, "1d")).write.partitionBy("symbol").parquet(path)
    return spark.read.parquet(path).select(*COLS)
