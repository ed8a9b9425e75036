"""Splits, scalers, calibration, models and their registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import candles as K
from tidemark.operators import mlops as M
from tidemark.plans.q_aggregates import LAB, labelled
from tidemark.plans.registry import query, rounded, with_candles
from tidemark.session import stored
from tidemark.sources.tables import candles, predictions, table

query("ml_robust_scaler", with_candles("SELECT symbol, ts, round((close - m) / coalesce(nullif(b - a, 0), 1), 6) + 0.0 AS close FROM c, (SELECT quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.5) AS m, quantile_cont(close, 0.75) AS b FROM c)"))(lambda spark, d: rounded(M.robust_scale(candles(spark, d).select("symbol", "ts", "close"), ["close"])))
query("ml_standard_scaler", with_candles("SELECT symbol, ts, round((close - m) / coalesce(nullif(s, 0), 1), 6) + 0.0 AS close FROM c, (SELECT avg(close) AS m, stddev_pop(close) AS s FROM c)"))(lambda spark, d: rounded(M.standard_scale(candles(spark, d).select("symbol", "ts", "close"), ["close"])))
query("ml_purged_kfold", with_candles("""SELECT symbol, ts, fold, i >= a AND i < b AS is_test, i < a - 5 OR i >= b + 5 AS is_train FROM (SELECT symbol, ts, i, fold, fold * (n // 5) + least(fold, n % 5) AS a, fold * (n // 5) + least(fold, n % 5) + n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS b
  FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM c), (SELECT unnest(range(0, 5))::INTEGER AS fold))"""))(lambda spark, d: M.purged_folds(candles(spark, d).select("symbol", "ts"), 5, 5).select("symbol", "ts", "fold", "is_test", "is_train"))
_SPLIT = "SELECT symbol, ts, CASE WHEN i > n - s THEN 'valid' WHEN i <= n - s - {e} THEN 'train' END AS split FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, least(greatest({least}, floor({f} * count(*) OVER (PARTITION BY symbol))), floor(count(*) OVER (PARTITION BY symbol) / 2)) AS s FROM c)"
query("ml_embargo_split", with_candles(_SPLIT.format(e=10, least=100, f="0.0")))(lambda spark, d: M.tail_split(candles(spark, d).select("symbol", "ts"), 0.0, 100, 10))
query("ml_tail_split", with_candles(_SPLIT.format(e=0, least=50, f="0.2::DOUBLE")))(lambda spark, d: M.tail_split(candles(spark, d).select("symbol", "ts"), 0.2, 50))
_P = "p AS (SELECT *, 1 / (1 + exp(-(close - open) / 10)) AS up FROM c)"
query("ml_expand_probs", with_candles("SELECT symbol, ts, round(greatest(1 - up, 1e-6) / t, 8) AS prob_down, round(1e-6 / t, 8) AS prob_flat, round(greatest(up, 1e-6) / t, 8) AS prob_up FROM (SELECT *, greatest(1 - up, 1e-6) + 1e-6 + greatest(up, 1e-6) AS t FROM p)", more=_P))(
    lambda spark, d: rounded(predictions(spark, d).select("symbol", "ts", *[x.alias(f"prob_{k}") for k, x in zip(("down", "flat", "up"), M.expand_probs([F.col("prob_down"), F.col("prob_up")], [0, 2]))]), 8)
)
query("ml_constant_model", with_candles("SELECT symbol, ts, round(1 / (1 + 2e-6), 8) AS prob_down, round(1e-6 / (1 + 2e-6), 8) AS prob_flat, round(1e-6 / (1 + 2e-6), 8) AS prob_up FROM c"))(
    lambda spark, d: rounded(candles(spark, d).select("symbol", "ts", *[x.alias(f"prob_{k}") for k, x in zip(("down", "flat", "up"), M.expand_probs([F.lit(1.0)], [0]))]), 8)
)
query("ml_grey_ci", with_candles("SELECT regime, symbol, ts, CASE regime WHEN 'low' THEN 0.48 WHEN 'high' THEN 0.42 ELSE 0.45 END::DOUBLE AS grey_lo, CASE regime WHEN 'low' THEN 0.52 WHEN 'high' THEN 0.58 ELSE 0.55 END::DOUBLE AS grey_hi, round(greatest(conf - h, 0), 8) AS ci_lo, round(least(conf + h, 1), 8) AS ci_hi FROM (SELECT *, CASE regime WHEN 'low' THEN 0.12 / 0.8 / 2 WHEN 'high' THEN 0.20 / 1.2 / 2 ELSE 0.16 / 1.0 / 2 END::DOUBLE AS h FROM l)", more=LAB))(
    lambda spark, d: rounded(labelled(spark, d).select("regime", "symbol", "ts", *[v.alias(k) for k, v in M.grey_and_interval(F.col("regime"), F.col("conf")).items()]), 8)
)
query("ml_registry", "SELECT p_brand AS model_type, p_size AS horizon, coalesce(max(p_name) FILTER (WHERE p_partkey % 40 = 0), max(p_name)) AS version FROM part GROUP BY ALL")(
    lambda spark, d: M.latest_versions(table(spark, d, "part").select(F.col("p_brand").alias("model_type"), F.col("p_size").alias("horizon"), F.col("p_name").alias("version"), (F.col("p_partkey") % 40 == 0).alias("active")))
)

FEATURES = ["logret", "zscore", "range"]


def samples(spark: SparkSession, d: str) -> DataFrame:
    c = candles(spark, d).withColumn("fee_buffer", X.fee_buffer())
    return c.select("symbol", "ts", X.log_return().alias("logret"), X.zscore("close", 50).alias("zscore"), ((F.col("high") - F.col("low")) / F.col("close")).alias("range"), X.target(5).alias("target"))


def trained(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample probabilities of the tail, by a forest fitted on the rows before the embargo."""
    rows = M.tail_split(samples(spark, d), 0.2, 50, 5)
    return M.train_forest(rows.where("split = 'train'"), FEATURES)(rows.where("split = 'valid'"))


_OUT = ["symbol", "ts", "target", "prob_down", "prob_flat", "prob_up"]


@query("ml_xgb_train")
def ml_xgb_train(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample probabilities of the tail by boosted trees, with the parameters of the best trial, used as suggested."""
    rows = stored(M.tail_split(samples(spark, d), 0.2, 50, 5), "samples")
    booster, _ = M.train_boosted(rows.where("split = 'train'"), FEATURES, embargo=5)
    return M.boosted_probabilities(rows.where("split = 'valid'"), booster).select(*_OUT)


query("ml_predict_batch")(lambda spark, d: trained(spark, d).select(*_OUT, F.greatest("prob_down", "prob_flat", "prob_up").alias("pred_conf")))
query("ml_predict_row")(lambda spark, d: K.newest(trained(spark, d), 1).select(*_OUT))
query("ml_calibrate_ovr")(lambda spark, d: M.calibrate(predictions_with_hit(spark, d), "prob_up", F.col("y") == 1).select("symbol", "ts", "prob_up", "prob_up_calibrated"))
query("ml_calibrate_regime")(lambda spark, d: M.calibrate(predictions_with_hit(spark, d), "prob_up", F.col("y") == 1, "regime").select("symbol", "ts", "regime", "prob_up", "prob_up_calibrated"))
query("ml_fit_calibrator")(lambda spark, d: M.calibrate(predictions_with_hit(spark, d), "pred_conf", F.col("y") == F.col("yhat")).groupBy("regime").agg(F.avg("pred_conf").alias("before"), F.avg("pred_conf_calibrated").alias("after"), F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy")))


def predictions_with_hit(spark: SparkSession, d: str) -> DataFrame:
    return stored(labelled(spark, d).select("symbol", "ts", "regime", "prob_up", "pred_conf", "y", "yhat"), "labelled")


@query("ml_lgbm_incremental")
def ml_lgbm_incremental(spark: SparkSession, d: str) -> DataFrame:
    """For every week but the first, the probabilities of its rows by the booster that the weeks before have grown; each week then adds
    its trees to last week's."""
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7)
    rows = stored(samples(spark, d).withColumn("week", week), "weeks")
    first, last = rows.agg(F.min("week"), F.max("week")).first()
    out, booster = None, None
    for w in range(first, last + 1):
        batch = rows.where(F.col("week") == w)
        if booster is not None:
            part = M.boosted_probabilities(batch, booster).select("week", *_OUT)
            out = part if out is None else out.unionByName(part)
        if w < last:
            booster = M.train_incremental(spark, batch, FEATURES, "target", booster, patience=10)
    return out if out is not None else M.boosted_probabilities(rows.limit(0), None).select("week", *_OUT)


query("pipe_train")(lambda spark, d: train_all(spark, d))


def train_all(spark: SparkSession, d: str) -> DataFrame:
    """One registry row for each horizon whose sample is large enough."""
    rows = []
    for h in (1, 5):
        c = stored(candles(spark, d).withColumn("fee_buffer", X.fee_buffer()).select("symbol", "ts", X.log_return().alias("logret"), X.zscore("close", 50).alias("zscore"), ((F.col("high") - F.col("low")) / F.col("close")).alias("range"), X.target(h).alias("target")), "samples")
        split = M.tail_split(c, 0.2, 50, h)
        scored = M.train_forest(split.where("split = 'train'"), FEATURES, trees=5)(split.where("split = 'valid'"))
        best = F.when(F.col("prob_up") >= F.greatest("prob_down", "prob_flat"), 1).when(F.col("prob_down") >= F.col("prob_flat"), -1).otherwise(0)
        rows.append(scored.agg(F.lit("forest").alias("model_type"), F.lit(h).alias("horizon"), F.avg((best == F.col("target")).cast("double")).alias("accuracy"), F.count("*").alias("n")))
    return rows[0].unionByName(rows[1])
