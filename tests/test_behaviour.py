"""Small series with known answers, invariants, and agreement of batch and stream."""

from datetime import datetime, timedelta

import brute_folds as folds
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import assignment, predicate
from tidemark.operators import candles as K
from tidemark.operators.policy import Rules, apply_policy
from tidemark.schema import interval_seconds
from tidemark.sources.clients import offline_klines, paged_source
from tidemark.sources.generators import offline_candles

T0 = datetime(2024, 1, 1)


def bars(spark, n, missing=(), minutes=1):
    rows = [("A", T0 + timedelta(minutes=i * minutes), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10.0 + i, 1) for i in range(n) if i not in missing]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, trades int")


def test_rsi_of_a_rise_is_fifty():
    assert np.allclose(folds.rsi(np.arange(1.0, 60.0)), 50)


def test_constant_series():
    x = np.full(40, 7.0)
    assert np.allclose(folds.ema(x, 12), 7) and np.allclose(folds.kama(x), 7)


def test_swing_moves_on_a_jump():
    close = np.concatenate([np.full(20, 100.0), np.full(5, 120.0)])
    width = np.full(25, 2.0)
    dist, _, since, _ = folds.swings(close, width, np.arange(25.0))
    assert dist[20] == 0 and since[20] == 0 and since[24] == 4


def test_gap_fill_makes_a_full_grid(spark):
    full = K.fill_gaps(bars(spark, 10, {3, 4, 5}), 60).orderBy("ts").collect()
    assert len(full) == 10
    assert [r.is_synthetic for r in full] == [i in (3, 4, 5) for i in range(10)]
    assert all(r.close == 102.5 and r.volume == 0 for r in full[3:6])


def test_gap_segments(spark):
    got = K.gap_segments(bars(spark, 10, {3, 4, 5}), 60).collect()
    assert [(r.gap_start, r.gap_end) for r in got] == [(T0 + timedelta(minutes=3), T0 + timedelta(minutes=5))]


def test_retention_and_upsert(spark):
    five = bars(spark, 5)
    once = K.upsert_retain(five.limit(0), five, 3)
    twice = K.upsert_retain(once, five, 3)
    assert sorted(r.ts for r in twice.collect()) == [T0 + timedelta(minutes=i) for i in (2, 3, 4)]
    assert K.changed(once, twice).count() == 0


def test_resample_keeps_volume(spark):
    b = bars(spark, 12).withColumn("close_time", F.col("ts"))
    r = K.resample(b, 300)
    assert r.agg(F.sum("volume")).first()[0] == b.agg(F.sum("volume")).first()[0]
    assert r.where("low > least(open, close) or high < greatest(open, close)").count() == 0


def test_incomplete_groups_are_dropped(spark):
    assert K.count_ratio_buckets(bars(spark, 12), 60, 5).count() == 2


@pytest.mark.parametrize("text, seconds", [("15m", 900), ("1M", 60), ("2w", 60), ("90s", 90), ("", 60), ("4h", 14400)])
def test_intervals(text, seconds):
    assert interval_seconds(text) == seconds


def test_expressions_are_safe(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    row = df.select(
        predicate("a > 0 and a < 2", df.columns).alias("x"), predicate("b > 0", df.columns).alias("y"), predicate("__import__('os').system('x')", df.columns).alias("z"),
        assignment("size = max(a, 3) * 2", df.columns).alias("s"), assignment("size = 1 / (a - a)", df.columns).alias("t"),
    ).first()
    assert tuple(row) == (True, False, False, 6.0, 0.0)


def test_policy_guards_and_filters(spark):
    rows = spark.createDataFrame([("A", T0 + timedelta(hours=i), 100.0, 0.9, 0.1, 0.9) for i in range(3)], "symbol string, ts timestamp_ntz, close double, prob_up double, prob_down double, pred_conf double")
    assert {r.side for r in apply_policy(rows).collect()} == {"long"}
    assert {r.why for r in apply_policy(rows, Rules(guards=("close > 200",))).collect()} == {"guard"}
    assert {r.why for r in apply_policy(rows, Rules(filters=(("close > 1", "block_entries"),))).collect()} == {"filter"}
    assert {r.side for r in apply_policy(rows, Rules(filters=(("close > 1", "allow_short_only"),))).collect()} == {"flat"}


def test_kline_source(spark):
    spark.dataSource.register(paged_source("klines", offline_klines()))
    raw = spark.read.format("klines").option("start_ms", 0).option("end_ms", 2_999_999).load()
    got = K.normalize_klines(raw).orderBy("ts").toPandas()
    want = offline_candles(spark, 50, "1970-01-01").orderBy("ts").toPandas()
    assert len(got) == 50
    np.testing.assert_allclose(got["close"], want["close"], atol=0.011)


def test_folds_of_a_short_series(spark):
    from tidemark.operators.folds import with_folds

    (out,) = with_folds(bars(spark, 1)).collect()
    assert out.rsi_14 == 50 and out.ema_12 == 100.5 and out.atr_14 == 0 and out.swing_time_low == 0


def decisions(spark, probs, rules=None, **more):
    from tidemark.operators.policy import Rules

    rows = [("A", T0 + timedelta(hours=i), 100.0, p, 1 - p, max(p, 1 - p)) for i, p in enumerate(probs)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, prob_up double, prob_down double, pred_conf double")
    return [r.side for r in apply_policy(df.withColumns(more), rules or Rules(thresholds=())).orderBy("ts").collect()]


def test_an_opposite_signal_is_held_off_for_three_bars(spark):
    assert decisions(spark, [0.9, 0.1, 0.1, 0.1, 0.1, 0.1]) == ["long"] * 4 + ["short"] * 2
    assert decisions(spark, [0.9, 0.1, 0.5, 0.1, 0.1, 0.1]) == ["long", "long", "flat", "long", "long", "short"]  # abstaining leaves the age


def test_thresholds_ask_for_the_allowed_sides(spark):
    long_only = Rules(filters=(("close > 1", "allow_long_only"),))
    assert decisions(spark, [0.9, 0.1], long_only) == ["long", "flat"]
    assert decisions(spark, [0.1], Rules(filters=(("close > 1", "allow_short_only"),))) == ["short"]
    assert decisions(spark, [0.1], Rules()) == ["flat"]  # smoothed confidence of the likelier class asks for long, whose utility is negative


def test_grey_bounds_by_regime(spark):
    lit = F.lit
    assert decisions(spark, [0.54], regime_bucket=lit("med")) == decisions(spark, [0.54], regime_bucket=lit("high")) == ["long"]
    assert decisions(spark, [0.52], regime_bucket=lit("high")) == ["flat"]
    assert decisions(spark, [0.54], regime_bucket=lit("none")) == ["flat"]  # bounds of 0.45 and 0.55


def test_rules_from_a_configuration(spark):
    from tidemark.operators.policy import exit_prices, rules_of

    text = {
        "filters": [{"name": "news", "type": "text_rag_any", "query": "calm", "action": "block_entries"}, {"name": "trend", "type": "metric", "expr": "close > 50", "action": "allow_long_only"}],
        "thresholds": [{"name": "gate", "long_if_prob_gt": 0.7}], "position_sizing": [{"name": "vol", "expr": "size = base_risk / max(close, 1e-4)"}],
        "risk_guards": [{"name": "stop", "expr": "close <= 1000"}], "exits": [{"name": "a", "take_profit": 0.01, "stop_loss": 0.005}],
    }
    rules = rules_of(text)
    assert rules.thresholds == ((0.7, None),) and rules.exits == ((0.01, 0.005),)
    df = spark.createDataFrame([("A", T0, 100.0, 0.9, 0.1, 0.9)], "symbol string, ts timestamp_ntz, close double, prob_up double, prob_down double, pred_conf double")
    got = apply_policy(df, rules).first()
    assert (got.side, got.size) == ("long", 1.0)
    assert apply_policy(df.withColumn("hits_news", F.lit(2)), rules).first().why == "filter"
    row = df.select(*[v.alias(k) for k, v in exit_prices(rules, F.lit("short"), F.col("close")).items()]).first()
    assert (row.take_profit, row.stop_loss) == pytest.approx((99.0, 100.5))
    with pytest.raises(ValueError):
        rules_of({"filters": [{"name": "x", "type": "image", "expr": "1"}]})


# sources that are fetched page by page
def test_pages_cover_the_range_once():
    from tidemark.sources.clients import offline_klines, pages_backward, pages_forward

    fetch = offline_klines()
    there = [r[0] for p in pages_forward(fetch, 0, 2_500 * 60_000, 1000) for r in p]
    assert there == [i * 60_000 for i in range(2501)]
    back = [r[0] for p in pages_backward(fetch, 2_500 * 60_000, start_ms=600_000, limit=1000) for r in p]
    assert min(back) <= 600_000 and len(back) == len(set(back))
    assert len([p for p in pages_backward(fetch, 10**11, minimum=2500, limit=1000)]) == 3
    some = []
    with pytest.raises(RuntimeError, match="4 pages end at"):
        some.extend(p for p in pages_backward(fetch, 10**11, start_ms=0, limit=10, max_pages=4))
    assert len(some) == 4
    assert max(r[0] for p in pages_backward(fetch, 10**12, minimum=1, now_ms=600_000) for r in p) == 600_000


def test_calls_are_repeated_and_then_fail():
    from tidemark.sources.clients import retried

    tries = []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x * 2

    assert retried(call, 4, wait=0) == (8, 3)
    tries.clear()
    with pytest.raises(OSError):
        retried(call, 1, attempts=2, wait=0)


def test_gaps_are_fetched_from_a_client(spark):
    """Ten bars of which 3, 4 and 5 are missing: the gap is asked of the client, and the full grid comes back."""
    from tidemark.sources.clients import paged_source

    every = [(i * 60_000, f"{100.0 + i}", f"{101.0 + i}", f"{99.0 + i}", f"{100.5 + i}", f"{10.0 + i}", i * 60_000 + 59_999) for i in range(10)]

    def fetch(start_ms, end_ms, limit):
        return [r for r in every if (start_ms is None or r[0] >= start_ms) and r[0] <= end_ms][:limit]

    rows = spark.createDataFrame(every, "open_time bigint, open string, high string, low string, close string, volume string, close_time bigint")
    have = K.normalize_klines(rows).where("ts_ms_utc not in (180000, 240000, 300000)").withColumn("symbol", F.lit("BTCUSDT"))
    gap = K.gap_segments(have, 60).first()
    assert (gap.gap_start, gap.gap_end) == (datetime(1970, 1, 1, 0, 3), datetime(1970, 1, 1, 0, 5))
    spark.dataSource.register(paged_source("stub_klines", fetch))
    ms = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    got = K.normalize_klines(spark.read.format("stub_klines").option("start_ms", ms(gap.gap_start)).option("end_ms", ms(gap.gap_end)).load()).withColumn("symbol", F.lit("BTCUSDT"))
    full = K.keep_last([have, got]).orderBy("ts").collect()
    assert [r.ts_ms_utc for r in full] == [r[0] for r in every] and [r.close for r in full] == [100.5 + i for i in range(10)]


def test_bars_derived_without_a_fetch(spark):
    five = K.newest(K.resample(bars(spark, 12).withColumn("close_time", F.col("ts")), 300), 2).orderBy("ts").collect()
    assert [(r.ts, r.volume) for r in five] == [(T0 + timedelta(minutes=5), sum(15.0 + i for i in range(5))), (T0 + timedelta(minutes=10), 41.0)]


# live bars
def test_the_machine_drops_late_ticks_and_keeps_state(spark, tmp_path):
    from tidemark.streaming import machine as L

    def write(rows):
        spark.createDataFrame([("A", datetime(2024, 1, 1, 0, m, s), p, 1.0, kind, n) for n, (m, s, p, kind) in rows], L.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        L.run(L.live_bars(L.event_stream(spark, str(tmp_path / "in")), 60, 0), str(tmp_path / "out"), str(tmp_path / "state"))
        return [(r.ts.minute, r.open, r.high, r.low, r.close, r.trades) for r in spark.read.schema(L.BAR).parquet(str(tmp_path / "out")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).orderBy("ts").collect()]

    write(list(enumerate([(0, 10, 5.0, "tick"), (0, 50, 7.0, "tick"), (1, 5, 6.0, "tick")])))
    assert run() == [(0, 5.0, 7.0, 5.0, 7.0, 2)]
    write([(3, (0, 59, 99.0, "tick")), (4, (1, 30, 4.0, "tick")), (5, (3, 0, 8.0, "tick"))])  # the first is late
    assert run()[1:] == [(1, 6.0, 6.0, 4.0, 4.0, 2)]
    write([(6, (3, 0, 0.0, "flush"))])
    assert run()[2:] == [(3, 8.0, 8.0, 8.0, 8.0, 1)]


def test_subscribers_never_fall_below_none(spark):
    from tidemark.plans.q_live import refcounts

    rows = spark.createDataFrame([("A", i, d) for i, d in enumerate([-1, 1, 1, -1, -1, -1, 1])], "symbol string, ts int, delta int")
    got = refcounts(rows).orderBy("ts").collect()
    assert [r.refs for r in got] == [0, 1, 2, 1, 0, 0, 1]
    assert [r.action for r in got] == [None, "start", None, None, "stop", None, "start"]


# models
def test_calibration_is_isotonic_regression(spark):
    from tidemark.operators.mlops import calibrate

    rng = np.random.default_rng(3)
    x = np.round(rng.random(200), 3)
    y = (rng.random(200) < x**2).astype(float)
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    blocks = [[y[x == v].mean(), (x == v).sum(), [v]] for v in xs]  # pool adjacent violators
    i = 0
    while i + 1 < len(blocks):
        if blocks[i][0] > blocks[i + 1][0]:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            i = max(0, i - 1)
        else:
            i += 1
    want = {v: max(1e-6, m) for m, _, vs in blocks for v in vs}
    df = spark.createDataFrame([(float(a), float(b), "r") for a, b in zip(x, y)], "p double, y double, regime string")
    for keys in (None, "regime"):
        for r in calibrate(df, "p", F.col("y") == 1, keys).collect():
            assert r.p_calibrated == pytest.approx(want[r.p], abs=1e-6)
    many = df.withColumn("regime", (F.col("p") * 1000).cast("int") % 20)
    with pytest.raises(ValueError):
        calibrate(many, "p", F.col("y") == 1, "regime")


def test_boosted_trees_learn_and_fall_back(spark):
    from tidemark.operators.mlops import SPACE, boosted_probabilities, suggest_params, train_boosted

    rows = spark.createDataFrame([("A", T0 + timedelta(hours=i), float(i % 3), float(i), i % 3 - 1) for i in range(120)], "symbol string, ts timestamp_ntz, a double, b double, target int")
    booster, trials = train_boosted(rows, ["a", "b"], trials=2, folds=2, embargo=2)
    best = F.greatest("prob_down", "prob_flat", "prob_up")
    hit = F.when(F.col("target") == -1, F.col("prob_down")).when(F.col("target") == 1, F.col("prob_up")).otherwise(F.col("prob_flat")) == best
    got = boosted_probabilities(rows, booster)
    tried = trials.orderBy("trial").collect()
    assert got.where(hit).count() >= 115 and len(tried) == 2 and max(r.score for r in tried) > 0.9
    assert all(r[k] == suggest_params(r.trial)[k] for r in tried for k in SPACE)  # as suggested
    first = max(tried, key=lambda r: (r.score, -r.trial)).trial
    assert len(booster.rounds) == suggest_params(first)["n_estimators"]
    assert abs(got.agg(F.max(F.abs(F.col("prob_down") + F.col("prob_flat") + F.col("prob_up") - 1))).first()[0]) < 1e-9
    one, _ = train_boosted(rows.withColumn("target", F.lit(1)), ["a"], trials=1, folds=2, embargo=2)
    assert boosted_probabilities(rows, one).first().prob_up > 0.9
    none, table = train_boosted(rows.limit(10), ["a"])
    few = boosted_probabilities(rows, none).first()
    assert none is None and table.count() == 0 and few.prob_up == few.prob_flat == few.prob_down


def test_incremental_booster(spark):
    """Every batch adds rounds to what the batches before have grown, and holds out its last rows by time."""
    from tidemark.operators.mlops import train_incremental

    rows = spark.createDataFrame([("A", T0 + timedelta(hours=i), float(i % 7), float(i % 3), (i % 7 > 3) - (i % 7 < 2)) for i in range(240)], "symbol string, ts timestamp_ntz, a double, b double, target int").withColumn("day", F.floor(F.datediff("ts", F.lit(T0.date())) / 5))
    booster, sizes = None, []
    for k in range(2):
        before = booster
        booster = train_incremental(spark, rows.where(F.col("day") == k), ["a", "b"], "target", booster, rounds=12, patience=4)
        sizes.append(len(booster.rounds))
        assert before is None or booster.rounds[: len(before.rounds)] == before.rounds
    assert sizes == [12, 24] and booster.losses[-1] < 0.95


def test_suggested_parameters_stay_in_their_space():
    from tidemark.operators.mlops import SPACE, suggest_params, trial_count

    for t in range(1, 200):
        assert all(SPACE[k][0] <= v <= SPACE[k][1] for k, v in suggest_params(t).items())
    assert [trial_count(n) for n in (0, 4000, 5999, 10**6)] == [5, 7, 7, 50]


def test_settings_from_text_and_environment():
    from tidemark import config

    got = config.settings("data: {interval: 5m}\nbacktest: {symbols: []}", {"SYMBOL": "X", "INTERVAL": ""})
    assert got["data"]["symbol"] == "X" and got["data"]["interval"] == "5m" and got["backtest"]["symbols"] == ["BTCUSDT"]
    assert config.settings("", {}) == config.DEFAULTS


def test_asof_over_buckets_equals_a_search(spark):
    from tidemark.operators.joins import asof_backward

    rng = np.random.default_rng(1)
    left = [("A" if i % 3 else "B", T0 + timedelta(minutes=int(m))) for i, m in enumerate(rng.integers(0, 12000, 300))]
    right = [("A", T0 + timedelta(minutes=int(m)), float(v) if v > 20 else None) for v, m in enumerate(sorted(set(rng.integers(3000, 12000, 40).tolist())))]
    got = asof_backward(spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "n int, symbol string, ts timestamp_ntz"), spark.createDataFrame(right, "symbol string, ts timestamp_ntz, v double"), ["v"], bucket=3600)
    for r in got.collect():
        before = [x for x in right if x[0] == r.symbol and x[1] <= r.ts]
        assert r.v == (before[-1][2] if before else None)
    assert got.count() == 300


def test_microprice_is_filled_in_one_pass(spark):
    """Rows without sizes take the last price, before any the first; no frame goes on from its row to the end, which is quadratic."""
    from tidemark.operators.flow import with_flow

    sizes = [(0.0, 0.0), (0.0, 0.0), (1.0, 3.0), (0.0, 0.0), (2.0, 2.0), (None, 1.0)]
    rows = [("A", T0 + timedelta(minutes=i), 10.0 + i, 12.0 + i, b, a) for i, (b, a) in enumerate(sizes)] + [("B", T0, 1.0, 2.0, 0.0, 0.0)]
    got = with_flow(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, bid_price double, ask_price double, bid_size double, ask_size double"), ["microprice"], order=("ts",))
    assert [r.microprice for r in got.orderBy("symbol", "ts").collect()] == [12.5, 12.5, 12.5, 12.5, 15.0, 15.0, None]
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_order_flow_of_one_time_follows_trade_ids(spark):
    """Rows of one time stand by trade id whatever their order in the input, and the first of a bucket's last time has its values."""
    from tidemark.operators.features import ORDER_FLOW, order_flow

    ticks = [(1, 0, 10.0, 2.0, False), (2, 1, 12.0, 4.0, False), (3, 1, 12.0, 8.0, True), (4, 1, 15.0, 16.0, False)]
    levels = [f"{s}_size_{k} double" for k in (1, 5, 10) for s in ("bid", "ask")]
    schema = ", ".join(["symbol string, ts timestamp_ntz, trade_id bigint, price double, quantity double, is_buyer_maker boolean, bid_price double, ask_price double, bid_size double, ask_size double", *levels])
    rows = [("A", T0 + timedelta(minutes=m), i, p, q, maker, p - 1, p + 1, q, 1.0, *[q, 1.0] * 3) for i, m, p, q, maker in ticks]
    for given in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(given, schema)
        for got in (order_flow(df, None, 3600).collect(), order_flow(df, df, 3600).collect()):
            assert [r.asDict() for r in got] == [{"symbol": "A", "ts": T0} | dict(zip(ORDER_FLOW, (6.0, 2.0, (11.0 + 13.0 * 4) / 5, 0.5, 1.0, 0.6, 0.6, 0.6)))]
    assert order_flow(df.drop("trade_id"), None, 3600).count() == 1


def test_subscribers_of_one_time_count_as_one(spark):
    """Changes of one time all have the number after them, as in the query's SQL, and the first of them has the action."""
    from tidemark.plans.q_live import refcounts

    changes = [(1, 0, -1), (2, 1, 1), (3, 1, 1), (4, 2, -1), (5, 2, -1), (6, 3, 1), (7, 3, -1)]
    for given in (changes, changes[::-1]):
        rows = spark.createDataFrame([("A", ts, i, d) for i, ts, d in given], "symbol string, ts int, trade_id bigint, delta int")
        got = refcounts(rows, ties=("trade_id",)).orderBy("trade_id").collect()
        assert [r.refs for r in got] == [0, 2, 2, 0, 0, 0, 0]
        assert [r.action for r in got] == [None, "start", None, "stop", None, None, None]
