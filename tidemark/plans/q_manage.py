"""Settings, compiled policies, file and database scans, warm-up of timeframes, staged runs, model catalogue, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import candles as K
from tidemark.operators import features as X
from tidemark.operators import mlops as M
from tidemark.operators import policy as P
from tidemark.operators.folds import with_folds
from tidemark.operators.stages import run_stages
from tidemark.plans.q_aggregates import LAB, _ece_sql, _mcc_sql, hit, labelled
from tidemark.plans.q_folds import _RSI
from tidemark.plans.registry import query, r, rounded, with_candles
from tidemark.schema import INTERVALS
from tidemark.session import scratch, stored
from tidemark.sources import sqlite
from tidemark.sources.files import ocr_text, scan_notes
from tidemark.sources.tables import candles, table

#: A file as a user would write it; an empty list counts as not set.
SETTINGS = """
data: {interval: 5m, fee_bp: 9}
policy: {allow_short: false}
backtest: {horizons: [], symbols: [ETHUSDT, BTCUSDT]}
"""
_SET = {"data": {"symbol": "SOLUSDT", "interval": "5m", "horizon_min": "15", "fee_bp": "9", "slippage_bp": "5", "lookback_days": "30", "window": "300"}, "policy": {"conf_up": "0.6", "conf_down": "0.4", "allow_short": "false", "prob_ema_alpha": "0.2", "min_hold_bars": "3", "abstain_margin": "0.03", "max_ci_width": "0.25", "eu_reward_atr": "1.5", "eu_risk_atr": "1.0", "min_expected_utility": "0.0"}, "sizing": {"kelly_clip": "0.5", "max_leverage": "1.0"}, "risk": {"risk_per_trade": "0.01", "daily_loss_limit": "0.03", "take_profit": "0.01", "stop_loss": "0.005"}, "backtest": {"symbols": "ETHUSDT,BTCUSDT", "intervals": "1m", "horizons": "5,15,60"}}
query("scan_config", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}', '{v}')" for s, e in _SET.items() for k, v in e.items()) + ") v(section, key, value)")(lambda spark, d: config.settings_table(spark, config.settings(SETTINGS, {"SYMBOL": "SOLUSDT", "INTERVAL": ""})))

RULES = """
filters:
  - {name: trend, type: metric, expr: "close > open", action: allow_long_only}
  - {name: wide, type: numeric, expr: "(high - low) / close > 0.5", action: block_entries}
  - {name: news, type: text_rag_any, query: "volatile events", action: block_entries}
thresholds:
  - {name: gate, long_if_prob_gt: 0.62, short_if_prob_lt: 0.38}
position_sizing:
  - {name: scaled, expr: "size = 100 / max(high - low, 1)"}
risk_guards:
  - {name: floor, type: custom, expr: "close >= 101", action: disable_trading_else}
exits:
  - {name: tp_sl, take_profit: 0.01, stop_loss: 0.005}
"""


@query("policy_compile", with_candles("SELECT symbol, ts, close >= 101 AS guards_ok, (high - low) / close > 0.5 AS blocked, TRUE AS may_long, NOT close > open AS may_short, round(100 / greatest(high - low, 1), 6) AS sized, round(close * CASE WHEN close > open THEN 1.01 ELSE 0.99 END, 6) AS take_profit, round(close * CASE WHEN close > open THEN 0.995 ELSE 1.005 END, 6) AS stop_loss, 0.62::DOUBLE AS long_at, 0.38::DOUBLE AS short_at FROM c"))
def policy_compile(spark: SparkSession, d: str) -> DataFrame:
    """A policy's text as columns: guards, blocks, allowed sides, size and exit prices of each bar."""
    rules = P.rules_of(config.parse(RULES))
    c = candles(spark, d)
    side = F.when(F.col("close") > F.col("open"), "long").otherwise("short")
    (long_at, short_at), = rules.thresholds
    cols = P.compile_rules(rules, c.columns) | P.exit_prices(rules, side, F.col("close")) | {"long_at": F.lit(long_at), "short_at": F.lit(short_at)}
    return rounded(c.select("symbol", "ts", *[v.alias(k) for k, v in cols.items()]))


@query("scan_documents", "SELECT doc_id, source AS folder, 'doc ' || CAST(doc_id AS VARCHAR) AS title, length(text) AS n_chars, 'text' AS kind FROM documents WHERE trim(text) <> ''")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    """Notes as files in folders, read with their folder, title and kind; the files are written first."""
    path = scratch(spark, "notes")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md\n"), "text").alias("value"), F.col("source").alias("folder"))
    docs.write.partitionBy("folder").option("lineSep", "\x1e").text(path)
    notes = scan_notes(spark, path).where("trim(text) <> ''")
    return notes.select(F.regexp_extract("title", "([0-9]+)$", 1).cast("bigint").alias("doc_id"), "folder", "title", F.length("text").cast("bigint").alias("n_chars"), "kind")


@query("scan_ocr", "SELECT r_name AS name, CAST(length(r_name) + 8 AS BIGINT) AS n_bytes, '' AS text FROM region")
def scan_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Image files with the text that a recognition library finds in them, and none where it is not installed or can't read an image."""
    path = scratch(spark, "images")
    rows = table(spark, d, "region").select("r_name", F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.col("r_name").cast("binary")).alias("content"))
    from tidemark.sources.files import write_files

    stored(write_files(rows, path, ".png"), "written")
    return ocr_text(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)).select("name", "n_bytes", "text")


@query("scan_sqlite", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def scan_sqlite(spark: SparkSession, d: str) -> DataFrame:
    """SQL text that the database runs: what comes back are its groups."""
    to = sqlite.database(spark, "orders")
    sqlite.append(table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")), to, "orders")
    text = "SELECT o_orderpriority, COUNT(*) AS n, SUM(cents) AS cents FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority"
    return sqlite.scan(spark, to, text, "o_orderpriority string, n bigint, cents bigint").select("o_orderpriority", "n", F.round(F.col("cents") / 100, 2).alias("total"))


@query("scan_feature_table", with_candles("SELECT symbol, ts, round(close, 6) AS close, CASE WHEN close > open THEN 2 WHEN close < open THEN 0 ELSE 1 END AS y, regime FROM (SELECT c.*, CASE WHEN volume >= b THEN 'high' WHEN volume <= a THEN 'low' ELSE 'med' END AS regime FROM c JOIN (SELECT symbol AS s, quantile_cont(volume, 0.33) AS a, quantile_cont(volume, 0.66) AS b FROM c GROUP BY 1) ON s = symbol)"))
def scan_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Feature files with a sidecar that names features and target; the regime comes from the one-hot columns."""
    from tidemark.functions import windows as W

    path = scratch(spark, "features")
    c = candles(spark, d)
    f = W.with_vol_bucket(c, "volume").withColumn("session", W.trading_session()).withColumns(W.one_hot()).withColumn("target", F.signum(F.col("close") - F.col("open")).cast("int"))
    f.select("symbol", "ts", "close", "target", *[f"vol_bucket_{b}" for b in ("low", "med", "high")]).write.parquet(f"{path}/data/part=1")
    spark.createDataFrame([("features", "close"), ("target", "target")], "role string, name string").coalesce(1).write.json(f"{path}/meta")
    roles = {x.name: x.role for x in spark.read.json(f"{path}/meta").collect()}  # the sidecar: a row for each column
    got = spark.read.parquet(f"{path}/data/part=*")
    regime = F.coalesce(*[F.when(F.col(f"vol_bucket_{b}") > 0.5, b) for b in ("high", "med", "low")], F.lit("med"))
    target = next(n for n, role in roles.items() if role == "target")
    return got.select("symbol", "ts", *[r(F.col(n)).alias(n) for n, role in roles.items() if role == "features"], M.encode_target(F.col(target)).alias("y"), regime.alias("regime"))


#: The timeframes that a start warms up, and the bounds of the bars that each needs.
FRAMES = ("1m", "3m", "5m", "10m", "15m", "30m", "1h", "4h", "1d")
LEAST_BARS, MOST_BARS, MORE_BARS = 1000, 10_000, 5


def bars_required(interval: str, days: int) -> int:
    return min(MOST_BARS, max(LEAST_BARS, max(1, days * 86400 // INTERVALS[interval]) + MORE_BARS))


def warmed(spark: SparkSession, d: str, days: int) -> DataFrame:
    """The newest bars that each timeframe needs, all of them from one aggregation of one-minute bars."""
    base = candles(spark, d, "1m")
    limit = F.coalesce(*[F.when(F.col("interval") == i, bars_required(i, days)) for i in FRAMES])
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc("ts"))
    return K.resample_many(base, {i: INTERVALS[i] for i in FRAMES}).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


_FRAMES_SQL = " UNION ALL ".join(f"SELECT symbol, '{i}' AS interval, time_bucket(INTERVAL '{INTERVALS[i]} seconds', ts, TIMESTAMP '1970-01-01') AS ts, {bars_required(i, 30)} AS most FROM c GROUP BY ALL" for i in FRAMES)
query("pipe_bootstrap", with_candles(f"SELECT symbol, interval, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars, count(*) > 0 AS ready FROM (SELECT * FROM ({_FRAMES_SQL}) QUALIFY row_number() OVER (PARTITION BY symbol, interval ORDER BY ts DESC) <= most) GROUP BY ALL", "1 minute"))(
    lambda spark, d: warmed(spark, d, 30).groupBy("symbol", "interval").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("bars"), (F.count("*") > 0).alias("ready"))
)


@query("pipe_bootstrap_history", with_candles("SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20') AS cached, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS fetched FROM c WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1"))
def pipe_bootstrap_history(spark: SparkSession, d: str) -> DataFrame:
    """A start with a cache: bars of the look-back that the cache has are reused, the others fetched, merged, and stored for the next start."""
    c = candles(spark, d).select("symbol", "ts", "close")
    cache = stored(c.where("ts < timestamp_ntz'2024-01-20'"), "cache").where("ts >= timestamp_ntz'2024-01-10'").withColumn("origin", F.lit("cached"))
    fresh = c.where("ts >= timestamp_ntz'2024-01-10'").join(cache.select("symbol", "ts"), ["symbol", "ts"], "left_anti").withColumn("origin", F.lit("fetched"))
    both = stored(K.keep_last([cache, fresh]), "history")
    return both.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(F.col("origin") == "cached").alias("cached"), F.count_if(F.col("origin") == "fetched").alias("fetched"))


_HOUR = "md5(strftime(ts, '%Y-%m-%d %H'))"


@query("agg_verify_sample", with_candles(f"SELECT symbol, ts, symbol <> 'click' AS matches FROM v QUALIFY {_HOUR} = max({_HOUR}) OVER (PARTITION BY symbol)", more="v AS (SELECT symbol, ts FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50)"))
def agg_verify_sample(spark: SparkSession, d: str) -> DataFrame:
    """One of the last 50 stored bars of each symbol, chosen by a hash of its time, against the source. The store has one symbol wrong."""
    c = candles(spark, d)
    last = K.newest(stored(c.withColumn("close", F.when(F.col("symbol") == "click", F.col("close") * 1.01).otherwise(F.col("close"))), "copy"), 50)
    one = last.groupBy("symbol").agg(F.max_by(F.struct("ts", "close"), F.md5(F.date_format("ts", "yyyy-MM-dd HH").cast("binary"))).alias("x")).select("symbol", "x.ts", F.col("x.close").alias("mine"))
    tol = F.greatest(F.lit(1e-8), F.abs(F.col("close")) * 1e-8)
    return one.join(c.select("symbol", "ts", "close"), ["symbol", "ts"]).select("symbol", "ts", (F.abs(F.col("mine") - F.col("close")) <= tol).alias("matches"))


@query("ml_gate", with_candles(f"""SELECT a.symbol, a.ece, b.mcc, n.accuracy, coalesce(a.ece <= 0.03 AND b.mcc > 0 AND n.accuracy > 0.5 AND w.worst <= 0.05, FALSE) AS passes FROM ({_ece_sql('symbol')}) a JOIN ({_mcc_sql('symbol')}) b USING (symbol)
  JOIN (SELECT symbol, round(avg(CAST(y = yhat AS DOUBLE)), 8) AS accuracy FROM l GROUP BY 1) n USING (symbol) JOIN (SELECT symbol, max(ece) AS worst FROM ({_ece_sql('symbol, regime')}) GROUP BY 1) w USING (symbol)""", more=LAB))
def ml_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model may go live: its calibration error, over all and in every regime, its correlation and its accuracy."""
    df = labelled(spark, d)
    worst = M.ece(df, "conf", hit(), keys=("symbol", "regime")).groupBy("symbol").agg(F.max("ece").alias("worst"))
    accuracy = df.groupBy("symbol").agg(F.avg(hit().cast("double")).alias("accuracy"))
    every = rounded(M.ece(df, "conf", hit(), keys=("symbol",)).join(M.mcc(df, "y", "yhat", keys=("symbol",)), "symbol").join(accuracy, "symbol").join(worst, "symbol"), 8)
    return every.select("symbol", "ece", "mcc", "accuracy", M.gate(F.col("ece"), F.col("mcc"), F.col("accuracy"), F.col("worst")).alias("passes"))


query("ml_stub_probs", with_candles("SELECT n.symbol, n.ts, round(1 / (1 + exp(-(coalesce(CASE WHEN n.i >= 15 AND w.l <> 0 THEN 100 - 100 / (1 + (w.g / w.den) / (w.l / w.den)) END, 50) - 50) / 10)), 8) AS prob_up FROM n LEFT JOIN w ON w.symbol = n.symbol AND w.i = n.i", more=_RSI, recursive=True))(
    lambda spark, d: rounded(M.stub_probability(with_folds(candles(spark, d).select("symbol", "ts", "open", "high", "low", "close", "volume"))), 8)
)
query("ml_catalog", "SELECT p_brand AS model_type, p_size AS horizon, p_name AS version, p_partkey % 40 = 0 AS active, round(p_retailprice, 6) AS metric, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey % 40 = 0 DESC, p_retailprice DESC, p_partkey) AS place FROM part")(
    lambda spark, d: rounded(M.catalogue(table(spark, d, "part").select(F.col("p_brand").alias("model_type"), F.col("p_size").alias("horizon"), F.col("p_name").alias("version"), (F.col("p_partkey") % 40 == 0).alias("active"), F.col("p_retailprice").alias("metric"), F.col("p_partkey").alias("id"))).drop("id"))
)
_RADICAL = "list_sum(list_transform(range(0, 12), lambda k: (trial // pow({b}, k)::BIGINT) % {b} / pow({b}, k + 1)))"
query("ml_suggest_params", "SELECT trial, CAST(3 + floor(u1 * 6) AS INTEGER) AS max_depth, CAST(200 + floor(u2 * 601) AS INTEGER) AS n_estimators, round(0.01 * pow(20, u3), 8) AS learning_rate, round(0.6 + 0.4 * u4, 8) AS subsample, round(0.4 + 0.6 * u5, 8) AS colsample_bytree, round(1 + 9 * u6, 8) AS min_child_weight, round(5 * u7, 8) AS gamma FROM (SELECT trial, " + ", ".join(f"{_RADICAL.format(b=b)} AS u{i}" for i, b in enumerate((2, 3, 5, 7, 11, 13, 17), 1)) + " FROM (SELECT unnest(range(1, 51)) AS trial))")(
    lambda spark, d: rounded(spark.createDataFrame([(i, *M.suggest_params(i).values()) for i in range(1, 51)], "trial bigint, " + ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in M.suggest_params(1).items())), 8)
)

_STAGED = "SELECT 'candles' AS stage, count(*) AS rows, 'run, cached' AS runs FROM c UNION ALL SELECT 'features', count(*), 'run, cached' FROM c UNION ALL SELECT 'labels', count(*), 'failed, run' FROM c WHERE close <> open UNION ALL SELECT 'metrics', count(DISTINCT symbol), 'not run, run' FROM c WHERE close <> open"


@query("pipe_self_train", with_candles(_STAGED))
def pipe_self_train(spark: SparkSession, d: str) -> DataFrame:
    """Stages whose third breaks in a first run; the second run takes the first two as they are and goes on. What each run did is returned."""
    root, tries = scratch(spark, "stages"), []

    def labels(t: dict) -> DataFrame:
        tries.append(1)
        if len(tries) == 1:
            raise ConnectionError("labels are not there yet")
        return t["features"].join(t["candles"].select("symbol", "ts", "open"), ["symbol", "ts"]).where("close <> open")

    stages = [
        ("candles", lambda t: candles(spark, d)), ("features", lambda t: X.simple_features(t["candles"])), ("labels", labels),
        ("metrics", lambda t: t["labels"].groupBy("symbol").agg(F.avg((F.col("close") > F.col("open")).cast("double")).alias("rising"), F.count("*").alias("n"))),
    ]
    done: dict[str, list[str]] = {name: [] for name, _ in stages}
    for _ in range(2):
        try:
            log = dict(run_stages(spark, root, stages))
        except ConnectionError:
            log = {"candles": "run", "features": "run", "labels": "failed"}
        for name, entries in done.items():
            entries.append(log.get(name, "not run"))
    parts = [spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("stage"), F.count("*").alias("rows"), F.lit(", ".join(entries)).alias("runs")) for name, entries in done.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# what the reference lacks, from Spark
_W = "OVER (PARTITION BY symbol ORDER BY volume, ts)"
query("win_rank", with_candles(f"SELECT symbol, ts, row_number() {_W} AS place, rank() OVER (PARTITION BY symbol ORDER BY trades) AS ranked, dense_rank() OVER (PARTITION BY symbol ORDER BY trades) AS dense, ntile(10) {_W} AS tile, round(percent_rank() OVER (PARTITION BY symbol ORDER BY trades), 8) AS share, round(cume_dist() OVER (PARTITION BY symbol ORDER BY trades), 8) AS below, round(lag(close, 2) {_W}, 6) AS two_before, round(lead(close, 1, 0.0) {_W}, 6) AS next_one, round(nth_value(close, 3) {_W}, 6) AS third FROM c"))(lambda spark, d: ranked(candles(spark, d)))


def ranked(c: DataFrame) -> DataFrame:
    by_volume, by_trades = Window.partitionBy("symbol").orderBy("volume", "ts"), Window.partitionBy("symbol").orderBy("trades")
    return rounded(c.select(
        "symbol", "ts", F.row_number().over(by_volume).cast("bigint").alias("place"), F.rank().over(by_trades).cast("bigint").alias("ranked"), F.dense_rank().over(by_trades).cast("bigint").alias("dense"), F.ntile(10).over(by_volume).cast("bigint").alias("tile"),
        F.percent_rank().over(by_trades).alias("share"), F.cume_dist().over(by_trades).alias("below"), F.lag("close", 2).over(by_volume).alias("two_before"), F.lead("close", 1, 0.0).over(by_volume).alias("next_one"), F.nth_value("close", 3).over(by_volume).alias("third"),
    ), 8).withColumns({c: r(F.col(c)) for c in ("two_before", "next_one", "third")})


query("win_range", with_candles("SELECT symbol, ts, round(sum(volume) OVER w, 6) AS volume_6h, count(*) OVER w AS bars_6h, round(max(high) OVER w, 6) AS high_6h FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 hours PRECEDING AND CURRENT ROW)"))(
    lambda spark, d: (lambda w: rounded(candles(spark, d).select("symbol", "ts", F.sum("volume").over(w).alias("volume_6h"), F.count("*").over(w).alias("bars_6h"), F.max("high").over(w).alias("high_6h"))))(Window.partitionBy("symbol").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-21600, 0))
)
