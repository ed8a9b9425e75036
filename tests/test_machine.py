"""The live machine: against a loop over the events of one symbol, by trade id, and without one task that takes all ticks of a symbol."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import machine as L

T0 = datetime(2024, 1, 1)


def loop(batches, width, grace):
    """Bars that come out, by events (second, price, quantity, kind, seq, id) of one symbol."""
    bars, closed, out = {}, None, []
    for events in batches:
        for t, price, quantity, kind, _, number in sorted(events, key=lambda e: e[4:]):
            b, limit = t // width * width, None
            if kind == "tick":
                if closed is not None and b <= closed:
                    continue
                bars.setdefault(b, []).append((t, number, price, quantity))
                limit = None if grace is None else t - width - grace
            else:
                limit = t if kind == "close" else max(bars, default=0)
            for x in sorted(bars):
                if limit is not None and x <= limit:
                    rows = bars.pop(x)
                    prices, quantities = [[r[k] for r in rows if r[k] is not None] for k in (2, 3)]
                    out.append((x, min(rows, key=lambda r: r[:2])[2], max(prices, default=None), min(prices, default=None), max(rows, key=lambda r: r[:2])[2], sum(quantities) if quantities else None, len(rows)))
                    closed = x if closed is None else max(closed, x)
    return sorted(out)


@pytest.mark.parametrize("grace", [0, 90, None])
def test_the_machine_equals_a_loop(spark, tmp_path, grace):
    rng = np.random.default_rng(5)
    tapes = {}
    for symbol in ("A", "B", None):
        t = np.sort(rng.integers(-600, 3000, 400)) + rng.integers(-80, 80, 400) * (rng.random(400) < 0.2)
        number = iter(rng.permutation(1000).tolist())
        events = [(int(x), None if rng.random() < 0.1 else float(rng.integers(90, 110)), None if rng.random() < 0.1 else float(rng.integers(1, 5)), "tick", i // 3, next(number)) for i, x in enumerate(t)]
        events += [(int(rng.integers(0, 3000)), None, None, "close", int(rng.integers(0, 133)), next(number)) for _ in range(3)]
        events.sort(key=lambda e: e[4:])
        late = [events.pop(int(rng.integers(0, 150))) for _ in range(20)]
        tapes[symbol] = [events[:130], events[130:260] + late, [*events[260:], (0, None, None, "flush", 10**9, 0)]]
    for k in range(3):
        rows = [(s, T0 + timedelta(seconds=e[0]), *e[1:]) for s, parts in tapes.items() for e in parts[k]]
        rng.shuffle(order := list(range(len(rows))))
        spark.createDataFrame([rows[i] for i in order], L.EVENT_ID).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        L.run(L.live_bars(L.event_stream(spark, str(tmp_path / "in")), 60, grace), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(L.BAR).parquet(str(tmp_path / "out")).select("symbol", (F.unix_seconds("ts") - int((T0 - datetime(1970, 1, 1)).total_seconds())).alias("t"), "open", "high", "low", "close", "volume", "trades").collect()
    for symbol, parts in tapes.items():
        assert sorted(tuple(r)[1:] for r in got if r.symbol == symbol) == loop(parts, 60, grace), symbol


def tape(spark, n):
    """Ticks of one symbol, every time twice, the larger trade id first."""
    k = F.col("id")
    return spark.range(n, 0, -1, 4).select(F.lit("A").alias("event_type"), F.expr("timestamp_ntz'2024-01-12 09:00:00' + make_dt_interval(0, 0, 0, id div 2)").alias("ts"), k.alias("user_id"), (k % 97).cast("double").alias("value"), F.lit('{"k": 1}').alias("props"), k.alias("event_id"))


def test_ticks_of_one_time_go_by_trade_id_and_spread_over_tasks(spark, tmp_path):
    from tidemark.plans.q_live import st_recover
    from tidemark.sources.tables import candles

    n = 40_000
    tape(spark, n).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return [(found.apply(i).stageId(), found.apply(i).attemptId()) for i in range(found.size())]

    before = set(stages())
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = st_recover(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(key)
    names = ("symbol", "ts", "open", "high", "low", "close", "volume", "trades")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(tuple(r) for r in candles(spark, str(tmp_path)).select(*names).collect())
    most = 0
    for stage in set(stages()) - before:
        tasks = store.taskList(*stage, 1000)
        for i in range(tasks.size()):
            m = tasks.apply(i).taskMetrics()
            most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    assert 0 < most < n / 2, "one task read the ticks of a symbol"
