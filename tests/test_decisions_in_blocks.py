"""Policy and backtests over series in blocks against loops over whole series."""

from dataclasses import replace
from datetime import datetime, timedelta

import brute_loops
import numpy as np
import pandas as pd
import pytest

from tidemark.operators import backtest as B
from tidemark.operators import policy as P

T0 = datetime(2024, 1, 1)


def predictions(seed=1, n=900):
    """A long series and a short one, with rows that guards and filters stop, and a balance that falls."""
    rng = np.random.default_rng(seed)
    parts = []
    for symbol, m in (("hot", n), ("b", 7), ("c", 1)):
        up = np.clip(0.5 + 0.4 * np.sin(np.arange(m) / 9) + 0.15 * rng.standard_normal(m), 0.01, 0.99)
        close = 100 + np.cumsum(rng.standard_normal(m))
        parts.append(pd.DataFrame({"symbol": symbol, "ts": [T0 + timedelta(hours=i) for i in range(m)], "open": close - 1, "close": close, "high": close + 1, "low": close - 1, "prob_up": up, "prob_down": 1 - up, "pred_conf": np.maximum(up, 1 - up), "regime_bucket": rng.choice(["low", "med", "high", "odd"], m), "balance": 10000 * (1 + np.cumsum(rng.standard_normal(m)) / 100), "trades": rng.integers(0, 9, m)}))
    return pd.concat(parts)


RULES = P.Rules(guards=("trades > 0",), filters=(("close > 104", "block_entries"), ("open > 97 and trades > 3", "allow_long_only")), thresholds=((0.62, 0.38), (None, 0.55)), sizing=())


@pytest.mark.parametrize("block", [17, 100_000])
@pytest.mark.parametrize("hold", [0, 3])
def test_policy_equals_the_loop(spark, block, hold):
    pdf, s = predictions(), replace(P.Settings(), min_hold=hold)
    got = P.apply_policy(spark.createDataFrame(pdf), RULES, s, block).toPandas()
    inputs = brute_inputs(spark, pdf, s)
    assert len(got) == len(pdf)
    sides = set()
    for symbol, part in inputs.groupby("symbol"):
        want = brute_loops.decide(part, s, RULES.thresholds)
        mine = got[got["symbol"] == symbol].sort_values("ts")
        assert mine["side"].tolist() == want["side"].tolist() and mine["why"].tolist() == want["why"].tolist()
        np.testing.assert_allclose(mine["size"], want["size"], atol=1e-9)
        np.testing.assert_allclose(mine["smoothed"].astype(float), want["smoothed"].astype(float), atol=1e-9)
        sides |= {*want["side"], *want["why"]}
    assert sides == {"long", "short", "flat", "guard", "filter", "abstain", "entry"}


def brute_inputs(spark, pdf, s):
    d = spark.createDataFrame(pdf)
    d = d.withColumns({"atr": P.F.lit(None).cast("double"), "ci_width": P.F.lit(0.0)})
    lo, hi = P.grey_zone(P.F.col("regime_bucket"))
    return d.withColumns(P.compile_rules(RULES, d.columns, s.allow_short) | P.expected_utility(s) | {"grey_lo": lo, "grey_hi": hi}).toPandas()


def test_states_compose():
    rng = np.random.default_rng(0)
    for hold in (0, 1, 3):
        signal = rng.choice([P.HOLD, P.FLAT, P.LONG, P.SHORT], 200, p=[0.2, 0.1, 0.4, 0.3])
        f = P.transitions(signal, hold)
        whole = P.composed(f)
        for start in range(2 * hold + 3):
            at = start
            for i in range(200):
                at = f[i, at]
                assert whole[i, start] == at


def bars(seed=3, n=700):
    pdf = predictions(seed, n)
    rng = np.random.default_rng(seed)
    m = len(pdf)
    return pdf.assign(volume=rng.integers(0, 50, m).astype(float), side=rng.choice(["long", "short", "flat"], m, p=[0.45, 0.35, 0.2]), size=rng.random(m), bucket=rng.choice(["low", "med", "high", "odd"], m))


@pytest.mark.parametrize("block", [60, 100_000])
@pytest.mark.parametrize("costs", [B.Costs(funding_bp=1.0), B.Costs(latency_bars=0, max_fill=0.5), B.Costs(latency_bars=3, maker_bp=2.0)])
def test_backtest_equals_the_loop(spark, block, costs):
    pdf = bars()
    got = B.backtest(spark.createDataFrame(pdf), costs, block).toPandas()
    for symbol, part in pdf.groupby("symbol"):
        part = part.sort_values("ts")
        width = part["high"] - part["low"]
        want = brute_loops.run_series(part.assign(spread=width.rolling(20, min_periods=1).median(), avg_volume=part["volume"].rolling(50, min_periods=1).mean()), costs)
        mine = got[got["symbol"] == symbol]
        for kind in ("trade", "equity"):
            a, b = (x[x["kind"] == kind].sort_values("exit_time") for x in (mine, want))
            assert len(a) == len(b) and (kind == "equity" or symbol == "c" or len(a) > 0)
            assert a["exit_time"].tolist() == b["exit_time"].tolist() and a["entry_time"].tolist() == b["entry_time"].tolist() and a["side"].tolist() == b["side"].tolist()
            for c in ("size", "entry_price", "exit_price", "pnl", "equity"):
                np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-8)


@pytest.mark.parametrize("block", [2, 50, 100_000])
def test_flipped_positions_equal_the_loop(spark, block):
    pdf = bars(5)
    got = B.flip_pnl(spark.createDataFrame(pdf), block).toPandas()
    for symbol, part in pdf.groupby("symbol"):
        want = brute_loops.flip_pnl(part)
        np.testing.assert_allclose(got[got["symbol"] == symbol].sort_values("ts")["pnl"], want["pnl"], atol=1e-9)


def test_a_long_series_is_decided_in_many_blocks(spark):
    """40,000 bars of one symbol in 20 blocks."""
    pdf = predictions(8, 40_000)
    pdf = pdf[pdf["symbol"] == "hot"]
    s = P.Settings()
    got = P.apply_policy(spark.createDataFrame(pdf).repartition(8), RULES, s, 2000).toPandas().sort_values("ts")
    want = brute_loops.decide(brute_inputs(spark, pdf, s), s, RULES.thresholds)
    assert got["side"].tolist() == want["side"].tolist()
    np.testing.assert_allclose(got["size"], want["size"], atol=1e-9)


def test_empty_tables(spark):
    d = spark.createDataFrame(bars()).limit(0)
    assert P.apply_policy(d).count() == 0 and B.backtest(d).count() == 0 and B.flip_pnl(d).count() == 0
