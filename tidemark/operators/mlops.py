"""Splits, scalers, class metrics, probability repair, calibration and the model registry."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import boosting
from tidemark.session import stored

EPS = 1e-6
#: The most regimes that calibration fits curves for; three by construction.
MAX_REGIMES = 16
#: Grey zones, interval bases and temperatures by regime.
GREY_ZONES = {"low": (0.48, 0.52), "high": (0.42, 0.58)}
GREY_DEFAULT = (0.45, 0.55)
CI_BASE = {"low": 0.12, "med": 0.16, "high": 0.20}
TEMPERATURE = {"low": 0.8, "med": 1.0, "high": 1.2}


def encode_target(y: Column) -> Column:
    """-1, 0, 1 become 0, 1, 2; anything else is 1."""
    return F.when(y == -1, 0).when(y == 1, 2).otherwise(1)


def ece(df: DataFrame, prob: str, correct: Column, bins: int = 15, keys: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error: weighted gap of confidence and accuracy by bin; a confidence of 1 falls beyond the last bin and is ignored."""
    b = df.select(*keys, F.floor(F.col(prob) * bins).alias("_b"), F.col(prob).alias("_p"), correct.cast("double").alias("_c"))
    total = F.sum("_n").over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]))
    g = b.groupBy(*keys, "_b").agg(F.avg("_p").alias("_p"), F.avg("_c").alias("_c"), F.count("*").alias("_n")).withColumn("_t", total)
    return g.groupBy(*keys).agg(F.sum(F.when(F.col("_b") < bins, F.abs(F.col("_p") - F.col("_c")) * F.col("_n") / F.col("_t")).otherwise(0.0)).alias("ece"))


def confusion(df: DataFrame, truth: str, pred: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def mcc(df: DataFrame, truth: str, pred: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Multi-class correlation from class counts; 0 where one side has a single class."""
    c = confusion(df, truth, pred, keys)
    rows = c.select(*keys, F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("a"), F.lit(0).alias("b"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("d")), F.struct(F.col("p").alias("k"), F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(0).alias("d")))).alias("x"))
    by = rows.groupBy(*keys, "x.k").agg(F.sum("x.a").cast("double").alias("a"), F.sum("x.b").cast("double").alias("b"), F.sum("x.d").cast("double").alias("d"))
    s = by.groupBy(*keys).agg(F.sum("d").alias("c"), F.sum("a").alias("s"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("aa")) * (F.col("s") * F.col("s") - F.col("bb")))
    return s.select(*keys, F.when(den > 0, (F.col("c") * F.col("s") - F.col("ab")) / den).otherwise(0.0).alias("mcc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights N / (K n)."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return g.join(F.broadcast(t)).select(label, (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))  # t is one row


def expand_probs(p: list[Column], have: list[int], k: int = 3) -> list[Column]:
    """Probabilities of k classes from those of the classes at hand; the others get EPS before scaling to 1."""
    full = [p[have.index(i)] if i in have else F.lit(EPS) for i in range(k)]
    full = [F.greatest(x, F.lit(EPS)) for x in full]
    total = full[0]
    for x in full[1:]:
        total = total + x
    return [x / total for x in full]


def grey_and_interval(bucket: Column, conf: Column) -> dict[str, Column]:
    pick = lambda values, default: F.coalesce(*[F.when(bucket == k, v) for k, v in values.items()], F.lit(default))
    half = pick(CI_BASE, 0.16) / pick(TEMPERATURE, 1.0) / 2
    return {
        "grey_lo": pick({k: v[0] for k, v in GREY_ZONES.items()}, GREY_DEFAULT[0]), "grey_hi": pick({k: v[1] for k, v in GREY_ZONES.items()}, GREY_DEFAULT[1]),
        "ci_lo": F.greatest(conf - half, F.lit(0.0)), "ci_hi": F.least(conf + half, F.lit(1.0)),
    }


def gate(ece_: Column, mcc_: Column, acc: Column, worst_regime: Column | None = None) -> Column:
    """Whether a model may go live; missing figures fail. worst_regime is the largest calibration error of a regime."""
    ok = (ece_ <= 0.03) & (mcc_ > 0) & (acc > 0.5)
    return F.coalesce(ok if worst_regime is None else ok & (worst_regime <= 0.05), F.lit(False))


def stub_probability(df: DataFrame) -> DataFrame:
    """The probability without a model: a logistic curve over rsi_14, a third where there is no such column."""
    up = 1 / (1 + F.exp(-(F.col("rsi_14") - 50) / 10)) if "rsi_14" in df.columns else F.lit(1 / 3)
    return df.select("symbol", "ts", up.alias("prob_up"))


#: The search space of boosted trees: bounds, and whether a parameter is whole or drawn on a logarithmic scale.
SPACE = {"max_depth": (3, 8, "int"), "n_estimators": (200, 800, "int"), "learning_rate": (0.01, 0.2, "log"), "subsample": (0.6, 1.0, ""), "colsample_bytree": (0.4, 1.0, ""), "min_child_weight": (1.0, 10.0, ""), "gamma": (0.0, 5.0, "")}
PRIMES = (2, 3, 5, 7, 11, 13, 17)


def trial_count(rows: int) -> int:
    return min(50, max(5, rows // 2000 + 5))


def suggest_params(trial: int, space: dict[str, tuple] | None = None) -> dict[str, int | float]:
    """Parameters of a trial (from 1) by a low-discrepancy sequence: each parameter takes the radical inverse in a prime base of its own, so
    trials spread evenly and repeat exactly."""
    out = {}
    for (name, (lo, hi, kind)), base in zip((space or SPACE).items(), PRIMES):
        u, n, scale = 0.0, trial, 1.0 / base
        while n:
            u, n, scale = u + n % base * scale, n // base, scale / base
        out[name] = int(lo + u * (hi - lo + 1)) if kind == "int" else lo * (hi / lo) ** u if kind == "log" else lo + u * (hi - lo)
    return out


def catalogue(registry: DataFrame) -> DataFrame:
    """Every version with its place among those of its type and horizon: active ones first, then by metric, then by id."""
    w = Window.partitionBy("model_type", "horizon").orderBy(F.desc("active"), F.desc("metric"), "id")
    return registry.withColumn("place", F.row_number().over(w).cast("bigint"))


def purged_folds(df: DataFrame, k: int, embargo: int, order: str = "ts") -> DataFrame:
    """(row, fold, is_test, is_train) for every row and fold: contiguous folds, the first n % k one longer; training leaves out an embargo around the test rows."""
    w = Window.partitionBy("symbol").orderBy(order)
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("symbol"))})
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    start = F.col("fold") * size + F.least("fold", more)
    stop = start + size + F.when(F.col("fold") < more, 1).otherwise(0)
    return d.withColumns({"is_test": (F.col("_i") >= start) & (F.col("_i") < stop), "is_train": (F.col("_i") < start - embargo) | (F.col("_i") >= stop + embargo)}).drop("_n")


def tail_split(df: DataFrame, fraction: float = 0.2, least: int = 50, embargo: int = 0, order: str = "ts") -> DataFrame:
    """'valid' for the last max(least, fraction * n) rows, at most half; 'train' for those before the embargo; null between."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    i = F.row_number().over(Window.partitionBy("symbol").orderBy(order))
    size = F.least(F.greatest(F.lit(least), F.floor(fraction * n)), F.floor(n / 2))
    return df.withColumn("split", F.when(i > n - size, "valid").when(i <= n - size - embargo, "train"))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR with exact quantiles; an IQR of 0 counts as 1. The quantiles are one row for each column."""
    out = df
    for c in columns:
        q = exact_quantiles(df.select(c), c, (0.25, 0.5, 0.75)).withColumnRenamed("_q", f"_q_{c}")
        out = out.join(F.broadcast(q), how="left")
    return out.withColumns({c: (F.col(c) - F.col(f"_q_{c}")[1]) / F.coalesce(F.nullif(F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0], F.lit(0.0)), F.lit(1.0)) for c in columns}).drop(*[f"_q_{c}" for c in columns])


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    m = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    out = df.join(F.broadcast(m))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}).drop(*[f"{n}_{c}" for c in columns for n in ("_m", "_s")])


def train_forest(df: DataFrame, features: list[str], label: str = "target", trees: int = 10, depth: int = 4):
    """A three-class forest over the features; missing ones count as 0. Returns the scoring function."""
    assembler = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=7).fit(assembler.transform(df.fillna(0.0, subset=features).withColumn("_y", encode_target(F.col(label)).cast("double"))))

    def predict(rows: DataFrame) -> DataFrame:
        scored = model.transform(assembler.transform(rows.fillna(0.0, subset=features)))
        p = vector_to_array("probability")
        parts = expand_probs([p[i] for i in range(model.numClasses)], list(range(model.numClasses)))
        return scored.withColumns({f"prob_{c}": x for c, x in zip(("down", "flat", "up"), parts)}).drop("_x", "rawPrediction", "probability", "prediction")

    return predict


def logloss(label: str = "_y") -> Column:
    """Mean log loss of prob_down, prob_flat and prob_up, as an aggregate."""
    p = F.when(F.col(label) == 0, F.col("prob_down")).when(F.col(label) == 2, F.col("prob_up")).otherwise(F.col("prob_flat"))
    return F.avg(-F.ln(F.greatest(p, F.lit(1e-15))))


def boosting_params(trial: dict) -> tuple[boosting.Params, int]:
    """A trial's parameters and number of rounds, as they are."""
    return boosting.Params(learning_rate=trial["learning_rate"], num_leaves=None, max_depth=int(trial["max_depth"]), gamma=trial["gamma"], min_hessian=trial["min_child_weight"], feature_fraction=trial["colsample_bytree"], row_fraction=trial["subsample"]), int(trial["n_estimators"])


def sampled(df: DataFrame, rows: int, key: str) -> DataFrame:
    """df, or if it has more than `rows` rows about that many of them, drawn by the hash of a column, so the same ones each time."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def class_mcc(y: np.ndarray, pred: np.ndarray) -> float:
    """Multi-class correlation; 0 where one side has a single class."""
    c = np.zeros((3, 3))
    np.add.at(c, (y, pred), 1)
    t, p, n = c.sum(axis=1), c.sum(axis=0), c.sum()
    den = np.sqrt((n * n - t @ t) * (n * n - p @ p))
    return float((np.trace(c) * n - t @ p) / den) if den > 0 else 0.0


#: Rows of the parameter search's and of the final fit's sample. A classifier is fitted on a bounded sample; all rows are scored.
SEARCH_ROWS, FIT_ROWS = 5_000, 20_000


def train_boosted(df: DataFrame, features: list[str], label: str = "target", trials: int | None = None, folds: int = 3, embargo: int = 60, least_rows: int = 50, search_rows: int = SEARCH_ROWS, fit_rows: int | None = FIT_ROWS):
    """Boosted trees with parameters chosen by purged cross-validation; returns (booster or None, table of trials).

    Each trial's parameters come from `suggest_params` and are used as they are. A trial's score is its mean correlation (MCC) over the
    folds; the first of the best wins. Every trial and fold is a task of its own over a sample of at most about search_rows rows; the final
    booster is fitted to one of fit_rows, or with fit_rows=None to all rows by `boosting.fit`. Fewer than least_rows rows are not fitted:
    None, for which `boosted_probabilities` gives thirds. Missing features have a bin of their own.
    """
    spark = df.sparkSession
    rows = stored(df.select("symbol", "ts", *[F.col(f).cast("double").alias(f) for f in features], encode_target(F.col(label)).alias("_y")).withColumn("_k", F.xxhash64("symbol", "ts")), "training")
    n = rows.count()
    fields = "trial int, score double, " + ", ".join(f"{k} double" for k in SPACE)
    if n < least_rows:
        return None, spark.createDataFrame([], fields)
    count = trial_count(n) if trials is None else trials
    split = purged_folds(sampled(rows, search_rows, "_k"), folds, embargo).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(count))))

    def tried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["symbol", "ts"])
        params, rounds = boosting_params(suggest_params(int(pdf["trial"].iat[0])))
        a, b = pdf[pdf["is_train"]], pdf[pdf["is_test"]]
        score = 0.0
        if len(a) and b["_y"].nunique() > 1:
            m = boosting.fit_local(a[features].to_numpy(np.float64), a["_y"].to_numpy(), params, rounds, features, a["_k"].to_numpy())
            score = class_mcc(b["_y"].to_numpy(), m.probabilities(b[features].to_numpy(np.float64)).argmax(axis=1))
        return pd.DataFrame({"trial": pdf["trial"].iloc[:1], "fold": pdf["fold"].iloc[:1], "score": score})

    scores = split.groupBy("trial", "fold").applyInPandas(tried, "trial int, fold int, score double").groupBy("trial").agg(F.avg("score").alias("score")).collect()
    table = sorted((r.trial, r.score) for r in scores)
    best = min(table, key=lambda x: (-x[1], x[0]))[0]
    params, rounds = boosting_params(suggest_params(best))
    if fit_rows is None:
        booster = boosting.fit(rows, features, "_y", params, rounds, key="_k")
    else:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["symbol", "ts"])
            return pd.DataFrame({"booster": [boosting.fit_local(pdf[features].to_numpy(np.float64), pdf["_y"].to_numpy(), params, rounds, features, pdf["_k"].to_numpy()).to_json()]})

        booster = boosting.Booster.from_json(sampled(rows, fit_rows, "_k").groupBy(F.lit(1).alias("one")).applyInPandas(whole, "booster string").first().booster)
    return booster, spark.createDataFrame([(t, s, *[float(v) for v in suggest_params(t).values()]) for t, s in table], fields)


def boosted_probabilities(df: DataFrame, booster: boosting.Booster | None) -> DataFrame:
    """df with prob_down, prob_flat and prob_up."""
    return boosting.predict(df, booster) if booster else df.withColumns({n: F.lit(1 / 3) for n in boosting.NAMES})


def train_incremental(spark: SparkSession, df: DataFrame, features: list[str], label: str, booster: boosting.Booster | None = None, valid_fraction: float = 0.3, least_valid: int = 32, rounds: int | None = None, patience: int = 30) -> boosting.Booster:
    """One batch of the incremental booster: `booster` continued with the batch's rows, or begun with them.

    The last rows by time, valid_fraction of them and least_valid at least, but at most half, are held out to stop at the best round.
    """
    n = df.count()
    held = min(max(least_valid, int(n * valid_fraction)), max(n // 2, 1))
    last = df.orderBy(F.desc("ts"), F.desc("symbol")).limit(held).agg(F.min(F.struct("ts", "symbol")).alias("m")).first().m
    at = F.lit(last.ts).cast(dict(df.dtypes)["ts"]) if last else None
    late = (F.col("ts") > at) | (F.col("ts") == at) & (F.col("symbol") >= last.symbol) if last else F.lit(False)
    rows = df.withColumns({"_y": encode_target(F.col(label)), "_k": F.xxhash64("symbol", "ts"), "_held": late})
    leaves = min(2 ** max(1, int(math.log2(max(4, len(features))))), 512)
    params = boosting.Params(learning_rate=0.05, num_leaves=leaves, l1=1e-3, l2=1e-3, min_rows=max(10, n // 50), feature_fraction=0.9, row_fraction=0.8, seed=1337)
    return boosting.fit(rows, features, "_y", params, rounds or max(40, min(400, n)), key="_k", valid="_held", patience=patience if held >= 20 else None, init=booster)


def calibrate(df: DataFrame, prob: str, hit: Column, keys: str | None = None) -> DataFrame:
    """df with prob calibrated by isotonic regression on `hit`, within each regime if a key column is given (regimes are few)."""
    rows = df.withColumn("_h", hit.cast("double"))

    def fitted(part: DataFrame) -> DataFrame:
        if part.select("_h").distinct().limit(2).count() < 2:
            return part.withColumn(f"{prob}_calibrated", F.col(prob))
        model = IsotonicRegression(featuresCol=prob, labelCol="_h", predictionCol="_c").fit(part)
        return model.transform(part).withColumn(f"{prob}_calibrated", F.least(F.greatest("_c", F.lit(EPS)), F.lit(1.0))).drop("_c")

    if keys is None:
        return fitted(rows).drop("_h")
    out = None
    found = [r[0] for r in rows.select(keys).distinct().limit(MAX_REGIMES + 1).collect()]
    if len(found) > MAX_REGIMES:
        raise ValueError(f"more than {MAX_REGIMES} values of {keys}: a curve is fitted for each")
    for k in found:
        part = fitted(rows.where(F.col(keys).eqNullSafe(k)))
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else fitted(rows)).drop("_h")


def latest_versions(registry: DataFrame) -> DataFrame:
    """The active version of each (model_type, horizon), else the largest by text order."""
    return registry.groupBy("model_type", "horizon").agg(F.coalesce(F.max(F.when(F.col("active"), F.col("version"))), F.max("version")).alias("version"))
