"""Recursive indicators and event loops; their twins are recursive CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import backtest as B
from tidemark.operators import policy as P
from tidemark.operators.folds import with_folds
from tidemark.plans.registry import query, rounded, with_candles
from tidemark.sources.tables import candles, predictions, signals

NUM = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM c)"


def ema_sql(span: int, name: str, source: str = "n", x: str = "close") -> str:
    return f"{name}(symbol, i, y) AS (SELECT symbol, i, {x} FROM {source} WHERE i = 1 UNION ALL SELECT n.symbol, n.i, e.y + {2.0 / (span + 1)!r} * (n.{x} - e.y) FROM {name} e JOIN {source} n ON n.symbol = e.symbol AND n.i = e.i + 1)"


def _emas(*spans: int) -> str:
    return ", ".join(ema_sql(s, f"e{s}") for s in spans)


def _joined(*spans: int) -> str:
    return "n " + " ".join(f"JOIN e{s} ON e{s}.symbol = n.symbol AND e{s}.i = n.i" for s in spans)


def fold(name: str, columns: list[str], sql: str, more: str, digits: int = 6) -> None:
    query(name, with_candles(sql, more=more, recursive=True))(lambda spark, d: rounded(with_folds(candles(spark, d).select("symbol", "ts", "open", "high", "low", "close", "volume")).select("symbol", "ts", *columns), digits))


fold("fold_ema", ["ema_12", "ema_26", "ema_50", "ema_200"], f"SELECT n.symbol, n.ts, {', '.join(f'round(e{s}.y, 6) AS ema_{s}' for s in (12, 26, 50, 200))} FROM {_joined(12, 26, 50, 200)}", f"{NUM}, {_emas(12, 26, 50, 200)}")
fold("fold_macd", ["macd", "macd_signal", "macd_hist"], "SELECT m.symbol, m.ts, round(m.m, 6) + 0.0 AS macd, round(s.y, 6) + 0.0 AS macd_signal, round(m.m - s.y, 6) + 0.0 AS macd_hist FROM m JOIN s ON s.symbol = m.symbol AND s.i = m.i", f"{NUM}, {_emas(12, 26)}, m AS (SELECT n.symbol, n.ts, n.i, e12.y - e26.y AS m FROM {_joined(12, 26)}), {ema_sql(9, 's', 'm', 'm').replace('FROM s e JOIN m n', 'FROM s e JOIN m n')}")
fold("fold_trend", ["trend_ema12_26", "trend_ema50_200", "trend_slope", "trend_adx_proxy"], f"SELECT n.symbol, n.ts, round(e12.y - e26.y, 6) + 0.0 AS trend_ema12_26, round(e50.y - e200.y, 6) + 0.0 AS trend_ema50_200, round(coalesce(e21.y - lag(e21.y) OVER (PARTITION BY n.symbol ORDER BY n.ts), 0), 6) + 0.0 AS trend_slope, round(abs(e21.y - e55.y) / nullif(n.close, 0), 6) + 0.0 AS trend_adx_proxy FROM {_joined(12, 26, 50, 200, 21, 55)}", f"{NUM}, {_emas(12, 26, 50, 200, 21, 55)}")
#: Weighted means with weights 13/14, of a series that starts at row `first`.
_RSI = f"""{NUM}, d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM n),
w(symbol, i, g, l, den) AS (SELECT symbol, i, greatest(d, 0.0), greatest(-d, 0.0), 1.0::DOUBLE FROM d WHERE i = 2 UNION ALL SELECT d.symbol, d.i, w.g * (1 - 1 / 14.0::DOUBLE) + greatest(d.d, 0.0), w.l * (1 - 1 / 14.0::DOUBLE) + greatest(-d.d, 0.0), w.den * (1 - 1 / 14.0::DOUBLE) + 1 FROM w JOIN d ON d.symbol = w.symbol AND d.i = w.i + 1)"""
fold("fold_rsi", ["rsi_14"], "SELECT n.symbol, n.ts, round(coalesce(CASE WHEN n.i >= 15 AND w.l <> 0 THEN 100 - 100 / (1 + (w.g / w.den) / (w.l / w.den)) END, 50), 6) AS rsi_14 FROM n LEFT JOIN w ON w.symbol = n.symbol AND w.i = n.i", _RSI)
_ATR = f"""{NUM}, r AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 0), coalesce(abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 0)) AS tr FROM n),
w(symbol, i, y, den) AS (SELECT symbol, i, tr, 1.0::DOUBLE FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.i, w.y * (1 - 1 / 14.0::DOUBLE) + r.tr, w.den * (1 - 1 / 14.0::DOUBLE) + 1 FROM w JOIN r ON r.symbol = w.symbol AND r.i = w.i + 1)"""
fold("fold_atr", ["atr_14"], "SELECT n.symbol, n.ts, round(coalesce(CASE WHEN n.i >= 14 THEN w.y / w.den END, f.y, 0), 6) AS atr_14 FROM n JOIN w ON w.symbol = n.symbol AND w.i = n.i LEFT JOIN (SELECT symbol, y / den AS y FROM w WHERE i = 14) f ON f.symbol = n.symbol", _ATR)
_KAMA = f"""{NUM}, p AS (SELECT *, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS st, abs(close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts)) AS ch FROM n),
q AS (SELECT *, CASE WHEN ch IS NOT NULL AND sum(st) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) > 0 THEN pow(ch / sum(st) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) * (2 / 3.0::DOUBLE - 2 / 31.0::DOUBLE) + 2 / 31.0::DOUBLE, 2) ELSE 2 / 31.0::DOUBLE END AS a FROM p),
k(symbol, i, y) AS (SELECT symbol, i, close FROM q WHERE i = 1 UNION ALL SELECT q.symbol, q.i, k.y + q.a * (q.close - k.y) FROM k JOIN q ON q.symbol = k.symbol AND q.i = k.i + 1)"""
fold("fold_kama", ["kama"], "SELECT n.symbol, n.ts, round(k.y, 6) AS kama FROM n JOIN k ON k.symbol = n.symbol AND k.i = n.i", _KAMA)
_SWING = f"""{NUM}, z AS (SELECT *, 1.5 * avg(high - low) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS d, epoch_us(ts) / 1e6 AS s FROM n),
k(symbol, i, hi, hit, lo, lot) AS (SELECT symbol, i, close, s, close, s FROM z WHERE i = 1 UNION ALL SELECT z.symbol, z.i, CASE WHEN z.close >= k.hi + z.d THEN z.close ELSE k.hi END, CASE WHEN z.close >= k.hi + z.d THEN z.s ELSE k.hit END, CASE WHEN z.close <= k.lo - z.d THEN z.close ELSE k.lo END, CASE WHEN z.close <= k.lo - z.d THEN z.s ELSE k.lot END FROM k JOIN z ON z.symbol = k.symbol AND z.i = k.i + 1)"""
fold("fold_swing", ["swing_dist_high", "swing_dist_low", "swing_time_high", "swing_time_low"], "SELECT z.symbol, z.ts, round(abs(z.close - k.hi), 6) AS swing_dist_high, round(abs(z.close - k.lo), 6) AS swing_dist_low, round(z.s - k.hit, 6) AS swing_time_high, round(z.s - k.lot, 6) AS swing_time_low FROM z JOIN k ON k.symbol = z.symbol AND k.i = z.i", _SWING)
query("fold_prob_ema", with_candles("SELECT n.symbol, n.ts, round(e.y, 8) AS smoothed FROM n JOIN e ON e.symbol = n.symbol AND e.i = n.i", more=f"{NUM}, f AS (SELECT *, greatest(1 / (1 + exp(-(close - open) / 10)), 1 - 1 / (1 + exp(-(close - open) / 10))) AS conf FROM n), e(symbol, i, y) AS (SELECT symbol, i, conf FROM f WHERE i = 1 UNION ALL SELECT f.symbol, f.i, e.y + 0.2::DOUBLE * (f.conf - e.y) FROM e JOIN f ON f.symbol = e.symbol AND f.i = e.i + 1)", recursive=True))(
    lambda spark, d: rounded(P.apply_policy(predictions(spark, d)).select("symbol", "ts", "smoothed"), 8)
)
#: The default rules: block on wide bars, long only on rising ones.
RULES = P.Rules(guards=("close > 0",), filters=(("(high - low) / close > 0.5", "block_entries"), ("close > open and trades > 3", "allow_long_only")), sizing=())
def policy_sql(blocked: str, may_short: str) -> str:
    """The state machine as a recursive CTE k; without short sides, long ones are always allowed here."""
    return f"""{NUM}, p AS (SELECT *, 1 / (1 + exp(-(close - open) / 10)) AS up FROM n),
z AS (SELECT symbol, ts, i, greatest(up, 1 - up) AS conf, {blocked} AS blocked, greatest(up, 1 - up) = 0.5 OR abs(greatest(up, 1 - up) - 0.5) < 0.03 AS abstains, {may_short} AS may_short,
  up * 1.5 * close * 0.004 - (1 - up) * close * 0.004 - 0.0012 * close AS eul, (1 - up) * 1.5 * close * 0.004 - up * close * 0.004 - 0.0012 * close AS eus FROM p),
k(symbol, ts, i, smooth, held, age, side, why) AS (
  SELECT DISTINCT symbol, TIMESTAMP '1970-01-01', 0::BIGINT, NULL::DOUBLE, 0, 0, 0, '' FROM z UNION ALL
  SELECT symbol, ts, i, smooth, CASE WHEN want IS NULL THEN held WHEN want <> 0 AND held <> 0 AND age < 3 THEN held ELSE want END, CASE WHEN want IS NULL THEN age WHEN want <> 0 AND (held = want OR (held <> 0 AND age < 3)) THEN age + 1 ELSE 0 END,
    CASE WHEN want IS NULL THEN 0 WHEN want <> 0 AND held <> 0 AND age < 3 THEN held ELSE want END, CASE WHEN blocked THEN 'filter' WHEN abstains THEN 'abstain' WHEN want <> 0 THEN 'entry' ELSE 'flat' END
  FROM (SELECT *, CASE WHEN blocked OR abstains THEN NULL WHEN (CASE sided WHEN 1 THEN eul WHEN -1 THEN eus END) > 0 THEN sided ELSE 0 END AS want
    FROM (SELECT *, CASE WHEN smooth <= 0.38 AND may_short THEN -1 WHEN smooth >= 0.62 THEN 1 WHEN eus > greatest(eul, 0) AND may_short THEN -1 WHEN eul > 0 THEN 1 ELSE 0 END AS sided
      FROM (SELECT z.*, k.held, k.age, CASE WHEN z.blocked THEN k.smooth ELSE coalesce(k.smooth + 0.2::DOUBLE * (z.conf - k.smooth), z.conf) END AS smooth FROM k JOIN z ON z.symbol = k.symbol AND z.i = k.i + 1))))"""


DECISIONS = "SELECT symbol, ts, CASE side WHEN 1 THEN 'long' WHEN -1 THEN 'short' ELSE 'flat' END AS side, CASE WHEN side = 0 THEN 0 ELSE round(100 * least(abs(smooth - 0.5) / greatest(smooth * (1 - smooth), 1e-6), 0.5), 6) END::DOUBLE AS size, round(smooth, 6) AS smoothed, why FROM k WHERE i > 0"
query("fold_policy", with_candles(DECISIONS, more=policy_sql("(high - low) / close > 0.5", "NOT (close > open AND trades > 3)"), recursive=True))(lambda spark, d: rounded(P.apply_policy(predictions(spark, d), RULES)))
_SIDE = "CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END"
query("fold_apply_decision", with_candles("SELECT n.symbol, n.ts, round(k.pnl, 4) + 0.0 AS pnl FROM n JOIN k ON k.symbol = n.symbol AND k.i = n.i", more=f"""{NUM}, z AS (SELECT *, {_SIDE} AS side FROM n),
k(symbol, i, side, entry, pnl) AS (SELECT symbol, i, side, close, 0.0::DOUBLE FROM z WHERE i = 1 UNION ALL SELECT z.symbol, z.i, z.side, CASE WHEN z.side <> k.side THEN z.close ELSE k.entry END, CASE WHEN z.side <> k.side THEN k.pnl + k.side * (z.close - k.entry) ELSE k.pnl END FROM k JOIN z ON z.symbol = k.symbol AND z.i = k.i + 1)""", recursive=True))(
    lambda spark, d: rounded(B.flip_pnl(signals(spark, d)), 4)
)
query("fold_sequences", with_candles("SELECT symbol, ts, round(list_sum(seq), 6) AS total, CAST(len(seq) AS INTEGER) AS n FROM (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS seq FROM c) WHERE len(seq) = 16"))(
    lambda spark, d: rounded(sequences(candles(spark, d), 16).select("symbol", "ts", F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("sequence").alias("n")))
)


def sequences(df: DataFrame, n: int, x: str = "close") -> DataFrame:
    """The n values before each row, where there are that many."""
    return df.withColumn("sequence", F.collect_list(x).over(X.by_time().rowsBetween(-n, -1))).where(F.size("sequence") == n)


def fixed(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).withColumns({"size": F.lit(1.0), "bucket": F.lit("med")})


#: Free of costs and limits, the loop trades each bar's side one bar later at that bar's close.
FREE = B.Costs(taker_bp=0.0, maker_bp=0.0, funding_bp=0.0, slip=(("low", 0.0), ("med", 0.0), ("high", 0.0)), max_fill=1.0)
query("fold_backtest", with_candles("SELECT x.symbol, CAST(sum(x.closes) AS BIGINT) AS trades FROM x GROUP BY 1", more=f"z AS (SELECT symbol, ts, lag({_SIDE}, 1) OVER (PARTITION BY symbol ORDER BY ts) AS want FROM c), x AS (SELECT symbol, CASE WHEN coalesce(want, 0) <> coalesce(lag(want) OVER (PARTITION BY symbol ORDER BY ts), 0) AND coalesce(lag(want) OVER (PARTITION BY symbol ORDER BY ts), 0) <> 0 THEN 1 ELSE 0 END AS closes FROM z)"))(
    lambda spark, d: B.backtest(fixed(spark, d), FREE).groupBy("symbol").agg(F.sum((F.col("kind") == "trade").cast("bigint")).alias("trades"))
)
_O20 = "OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)"
_COSTS = f"""{NUM}, f AS (SELECT *, {_SIDE} AS side, greatest(1 / (1 + exp(-(close - open) / 10)), 1 - 1 / (1 + exp(-(close - open) / 10))) AS conf, quantile_cont(high - low, 0.5) {_O20} AS spread, least(1.0, volume / avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)) AS fill FROM n),
z AS (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY ts) AS want, spread / 2 + spread * 0.4 * least(1.0, 1 / greatest(volume, 1e-6)) AS away, close * 0.0007 AS taker, close * CASE WHEN abs(conf - 0.5) > 0.1 THEN 0.0007 ELSE 0.0001 END AS fee FROM f),
k(symbol, ts, i, cash, side, size, entry, since, sold, exits, pnl, old_entry, old_since, old_side) AS (
  SELECT symbol, ts, i, 10000.0::DOUBLE, 0, 0.0::DOUBLE, 0.0::DOUBLE, NULL::TIMESTAMP, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, NULL::TIMESTAMP, 0 FROM z WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, cash + coalesce(pnl, 0) - CASE WHEN want <> 0 THEN fill * close * 0.0001 ELSE 0 END, want, CASE WHEN want <> 0 THEN fill ELSE 0 END, CASE WHEN want = side THEN entry WHEN want <> 0 THEN close + want * (away + fee) ELSE 0 END, CASE WHEN want = side THEN since WHEN want <> 0 THEN ts END, size, exits, pnl, entry, since, side
  FROM (SELECT *, CASE WHEN side <> 0 AND want <> side THEN side * (exits - entry) * size END AS pnl FROM (SELECT z.symbol, z.ts, z.i, z.close, z.want, z.fill, z.away, z.fee, k.cash, k.side, k.size, k.entry, k.since, z.close - k.side * (z.away + z.taker) AS exits FROM k JOIN z ON z.symbol = k.symbol AND z.i = k.i + 1)))"""
query("fold_backtest_costs", with_candles("""SELECT symbol, 'trade' AS kind, old_since AS entry_time, ts AS exit_time, CASE old_side WHEN 1 THEN 'long' ELSE 'short' END AS side, round(sold, 7) AS size, round(old_entry, 7) AS entry_price, round(exits, 7) AS exit_price, round(pnl, 7) + 0.0 AS pnl, NULL::DOUBLE AS equity FROM k WHERE pnl IS NOT NULL
UNION ALL SELECT k.symbol, 'equity', k.ts, k.ts, NULL, NULL, NULL, NULL, NULL, round(k.cash + k.side * (z.close - k.entry) * k.size, 7) FROM k JOIN z ON z.symbol = k.symbol AND z.i = k.i""", more=_COSTS, recursive=True))(lambda spark, d: rounded(B.backtest(fixed(spark, d), B.Costs(funding_bp=1.0)), 7))


@query("win_entry_plan", with_candles("SELECT symbol, round(hi, 6) AS high, round(lo, 6) AS low, round(hi - 0.618 * (hi - lo), 6) AS fib_lo, round(hi - 0.382 * (hi - lo), 6) AS fib_hi, round(last + 1.5 * a, 6) AS target, round(last - a, 6) AS stop FROM (SELECT symbol, max(high) AS hi, min(low) AS lo, arg_max(close, ts) AS last, arg_max(a, ts) AS a FROM (SELECT n.*, w.y / w.den AS a FROM n JOIN w ON w.symbol = n.symbol AND w.i = n.i QUALIFY row_number() OVER (PARTITION BY n.symbol ORDER BY n.ts DESC) <= 20) GROUP BY 1)", more=_ATR, recursive=True))
def win_entry_plan(spark: SparkSession, d: str) -> DataFrame:
    """Target, retracement zone and stop from the last 20 bars and the last ATR."""
    from tidemark.operators.candles import newest

    f = newest(with_folds(candles(spark, d).select("symbol", "ts", "open", "high", "low", "close", "volume")), 20)
    a = f.groupBy("symbol").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("c"), F.max_by("atr_14", "ts").alias("a"))
    rng = F.col("high") - F.col("low")
    return rounded(a.select("symbol", "high", "low", (F.col("high") - 0.618 * rng).alias("fib_lo"), (F.col("high") - 0.382 * rng).alias("fib_hi"), (F.col("c") + 1.5 * F.col("a")).alias("target"), (F.col("c") - F.col("a")).alias("stop")))
