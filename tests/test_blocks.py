"""Series in blocks: places, halos, carried sums and fills, and recursive indicators against loops over whole series."""

import brute_folds
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import blocks as K
from tidemark.operators.folds import FOLD_COLUMNS, Levels, recurrence, with_folds


def tape(spark, seed=2, n=900):
    rng = np.random.default_rng(seed)
    rows = [(["hot", "a", None][min(2, int(rng.random() * 8) // 6 + (rng.random() < 0.1))], int(rng.integers(0, 60)), i, float(rng.integers(-5, 6)), float(rng.integers(0, 9)) if rng.random() < 0.2 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, ts int, trade_id int, x double, y double").repartition(6)


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_places_of_series_that_span_partitions(spark, coalesced):
    rows, d = tape(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    got = K.placed(d, ["symbol"], ["ts", "trade_id"], 50).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in ("hot", "a", None):
        mine = sorted((r[1], r[2]) for r in rows if r[0] == s)
        assert [(r.ts, r.trade_id) for r in sorted((r for r in got if r.symbol == s), key=lambda r: r._i)] == mine
        assert sorted(r._i for r in got if r.symbol == s) == list(range(len(mine)))
    assert all(r._b == r._i // 50 for r in got)


def test_sums_and_fills_are_carried_over_blocks(spark):
    rows, d = tape(spark)
    p = K.placed(d, ["symbol"], ["ts", "trade_id"], 40)
    got = K.carried(p, ["symbol"], sums={"total": "x", "some": "y"}, lasts={"last": "y"}, firsts={"next": "y"}).collect()
    assert len(got) == len(rows)
    for s in ("hot", "a", None):
        mine = sorted((r for r in got if r.symbol == s), key=lambda r: r._i)
        assert len(mine) > (40 if s else 10)
        y = [r.y for r in mine]
        for i, r in enumerate(mine):
            assert r.total == sum(q.x for q in mine[: i + 1])
            assert r.some == (sum(v for v in y[: i + 1] if v is not None) if any(v is not None for v in y[: i + 1]) else None)
            assert r.last == next((v for v in reversed(y[: i + 1]) if v is not None), None)
            assert r.next == next((v for v in y[i:] if v is not None), None)


def test_finite_frames_reach_into_the_halo(spark):
    rows, d = tape(spark)
    p = K.haloed(K.placed(d, ["symbol"], ["ts", "trade_id"], 30), 20, 3, 30)
    with X.framed(K.in_block(["symbol"])):
        cols = {"m": X.sma("x", 20), "d": F.col("x") - X.lag("x"), "ahead": F.lead("x", 3).over(X.by_time())}
    got = p.withColumns(cols).where("_own").collect()
    for s in ("hot", "a", None):
        mine = sorted((r for r in got if r.symbol == s), key=lambda r: r._i)
        x = [r.x for r in mine]
        for i, r in enumerate(mine):
            assert r.m == pytest.approx(np.mean(x[max(0, i - 19) : i + 1])) and r.d == (x[i] - x[i - 1] if i else None) and r.ahead == (x[i + 3] if i + 3 < len(x) else None)
    with pytest.raises(ValueError):
        K.haloed(p, 31, rows=30)


def series(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    close = {"walk": 100 + np.cumsum(rng.standard_normal(n)), "rise": 100 + np.arange(n) * 0.5, "fall": 500 - np.arange(n) * 0.5, "flat": np.full(n, 7.0), "saw": 100 + np.arange(n) % 17 * 1.0, "zero": np.zeros(n)}[kind]
    width = np.abs(rng.standard_normal(n)) * (0 if kind in ("flat", "zero") else 1)
    return pd.DataFrame({"symbol": kind, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "high": close + width, "low": close - width / 2, "close": close})


@pytest.mark.parametrize("rows", [14, 37, 100_000])
def test_folds_equal_the_loop(spark, rows):
    parts = [series(k, n) for k, n in (("walk", 500), ("rise", 200), ("fall", 200), ("flat", 90), ("saw", 150), ("zero", 40))] + [series("walk", n, 3).assign(symbol=f"short{n}") for n in (1, 2, 13, 14, 15, 28, 29)]
    pdf = pd.concat(parts)
    got = with_folds(spark.createDataFrame(pdf), rows=rows).toPandas()
    assert len(got) == len(pdf) and list(got.columns) == [*pdf.columns, *FOLD_COLUMNS]
    for p in parts:
        name = p["symbol"].iat[0]
        mine = got[got["symbol"] == name].sort_values("ts")
        want = brute_folds.fold_series(p)
        for c in FOLD_COLUMNS:
            np.testing.assert_allclose(mine[c].to_numpy(), want[c].to_numpy(), rtol=0, atol=1e-9, err_msg=f"{name} {c}")


def test_one_long_series_spreads_over_tasks(spark):
    """200,000 bars of one symbol in 40 blocks; the largest holds no more than the median."""
    pdf = series("walk", 200_000, 9)
    d = with_folds(spark.createDataFrame(pdf).repartition(8), rows=5000)
    got = d.toPandas().sort_values("ts")
    want = brute_folds.fold_series(pdf)
    for c in FOLD_COLUMNS:
        np.testing.assert_allclose(got[c].to_numpy(), want[c].to_numpy(), rtol=0, atol=1e-9, err_msg=c)
    sizes = [r["count"] for r in K.placed(spark.createDataFrame(pdf), ["symbol"], ["ts"], 5000).groupBy("_b").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * np.median(sizes)


def test_recurrences_and_levels():
    rng = np.random.default_rng(1)
    a, b = rng.random(1000), rng.standard_normal(1000)
    y, want = 2.0, []
    for p, q in zip(a, b):
        y = p * y + q
        want.append(y)
    np.testing.assert_allclose(recurrence(a, b, 2.0), want, atol=1e-12)
    assert len(recurrence(a[:0], b[:0], 1.0)) == 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x, d = np.cumsum(rng.standard_normal(200)), np.abs(rng.standard_normal(200)) * 2
        f = Levels(x, d)
        xs, ds, ends = f.map()
        for level in np.concatenate([[-1e9, 1e9], x[:30], xs - ds]):
            h, moved = level, None
            for i in range(200):
                if x[i] >= h + d[i]:
                    h, moved = x[i], i
            first = np.flatnonzero(xs >= level + ds)
            assert (ends[first[0]] if len(first) else None) == moved
            followed, time = f.follow(level, -1.0, np.arange(200.0))
            assert followed[-1] == h and time[-1] == (-1.0 if moved is None else moved)


def test_folds_of_an_empty_table(spark):
    assert with_folds(spark.createDataFrame(series("walk", 3)).limit(0)).count() == 0


def brute_flow(rows):
    """Order-flow columns of one symbol's rows (ts, trade_id, price, quantity, maker, bid, bid size, ask, ask size), by loops."""
    out, cvd, ofi, impacts, last_micro = [], 0.0, 0.0, [], None
    rows = sorted(rows)
    micro = [((b * asz + a * bsz) / (bsz + asz)) if bsz + asz else None for *_, b, bsz, a, asz in rows]
    for i, (_, trade, price, q, maker, bid, bsz, ask, asz) in enumerate(rows):
        p = rows[i - 1] if i else None
        cvd += -q if maker else q
        if p:
            ofi += (bsz - p[6] if bid >= p[5] else 0) - (asz - p[8] if ask <= p[7] else 0)
        impacts.append(abs(price - p[2]) / q if p and q else None)
        known = [x for x in impacts[-50:] if x is not None]
        last_micro = micro[i] if micro[i] is not None else last_micro
        total = sum(r[3] for r in rows[max(0, i - 49) : i + 1])
        out.append((trade, cvd, ofi, np.mean(known) if known else None, 1.0 if total else None, last_micro if last_micro is not None else next((m for m in micro if m is not None), None)))
    return out


@pytest.mark.parametrize("size", [50, 64, 100_000])
def test_order_flow_with_ties_over_blocks(spark, size):
    """One symbol has most rows, and many rows share their time."""
    from tidemark.operators.flow import with_flow

    rng = np.random.default_rng(6)
    rows = [(["hot", "b"][int(rng.random() < 0.1)], int(rng.integers(0, 40)), i, float(rng.integers(90, 110)), float(rng.integers(0, 4)), bool(rng.random() < 0.5), float(rng.integers(90, 110)), float(rng.integers(0, 3)), float(rng.integers(90, 110)), float(rng.integers(0, 3))) for i in range(700)]
    d = spark.createDataFrame(rows, "symbol string, ts int, trade_id int, price double, quantity double, is_buyer_maker boolean, bid_price double, bid_size double, ask_price double, ask_size double").repartition(5)
    got = with_flow(d, ["cvd", "ofi", "roll_impact", "vpin", "microprice"], rows=size).collect()
    assert len(got) == 700
    for s in ("hot", "b"):
        want = brute_flow([r[1:] for r in rows if r[0] == s])
        mine = {r.trade_id: (r.cvd, r.ofi, r.roll_impact, r.vpin, r.microprice) for r in got if r.symbol == s}
        for trade, *values in want:
            assert mine[trade] == pytest.approx(tuple(values), abs=1e-9)


def test_candles_and_asof_joins_of_equal_times(spark):
    from datetime import datetime

    from tidemark.operators.candles import trades_to_candles
    from tidemark.operators.joins import asof_backward

    t = datetime(2024, 1, 1)
    rows = [("A", t, i, float((i * 7) % 11), 1.0, False) for i in range(20)]
    c = trades_to_candles(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id int, price double, quantity double, is_buyer_maker boolean").repartition(7), 60).first()
    assert (c.open, c.close) == (0.0, float(19 * 7 % 11))
    right = spark.createDataFrame([("A", t, i, float(i % 5)) for i in range(13)], "symbol string, ts timestamp_ntz, id int, v double").repartition(5)
    left = spark.createDataFrame([("A", t), ("A", datetime(2024, 1, 9))], "symbol string, ts timestamp_ntz")
    assert [r.v for r in asof_backward(left, right, ["v"], ties=("id",)).collect()] == [2.0, 2.0]
    assert [r.v for r in asof_backward(left, right, ["v"]).collect()] == [4.0, 4.0]
