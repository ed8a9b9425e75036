"""Boosted trees from histograms that Spark sums up, against a booster that goes over the rows one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B

FEATURES = ["a", "b", "c"]
SCHEMA = "id bigint, a double, b double, c double, y int, w double, held boolean"


def made_up(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)).round(1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    score = np.nan_to_num(x[:, 0]) + 0.5 * np.sign(np.nan_to_num(x[:, 1], nan=1.0)) + 0.4 * rng.standard_normal(n)
    y = np.digitize(score, [-0.5, 0.5])
    w = rng.choice([0.5, 1.0, 2.0], n)
    held = rng.random(n) < 0.25
    return x, y, w, held


def frame(spark, x, y, w, held, parts=5):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(k), float(u), bool(h)) for i, (r, k, u, h) in enumerate(zip(x, y, w, held))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(x, y, w, edges, p, rounds, keys, start=()):
    """Best-first growth by loops over rows and thresholds; returns the margins of all rows after each round."""
    n = len(y)
    m = np.zeros((n, 3)) if not len(start) else start.copy()
    out = []
    for r in range(rounds):
        e = np.exp(m - m.max(axis=1, keepdims=True))
        prob = e / e.sum(axis=1, keepdims=True)
        use = B.drawn(keys, p.seed, r, p.row_fraction)
        step = np.zeros_like(m)
        for k in range(3):
            g, h = (prob[:, k] - (y == k)) * w, 1.5 * prob[:, k] * (1 - prob[:, k]) * w
            allowed = B.allowed_features(p, r, k, x.shape[1])
            score = lambda i: max(abs(g[i].sum()) - p.l1, 0) ** 2 / (h[i].sum() + p.l2) / 2  # noqa: E731, B023

            def best(rows, depth):
                found = (0.0, None)
                if p.max_depth is not None and depth >= p.max_depth:
                    return found
                drawn = rows[use[rows]]  # noqa: B023
                for f in allowed:  # noqa: B023
                    v = x[:, f]
                    for t in edges[f]:
                        for missing_left in (False, True):
                            go = lambda i: np.where(np.isnan(v[i]), missing_left, v[i] <= t)  # noqa: E731, B023
                            left, right = drawn[go(drawn)], drawn[~go(drawn)]
                            if min(len(left), len(right)) < p.min_rows or min(h[left].sum(), h[right].sum()) < p.min_hessian:  # noqa: B023
                                continue
                            gain = score(left) + score(right) - score(drawn) - p.gamma  # noqa: B023
                            if gain > found[0] + 1e-10:
                                found = (gain, (rows[go(rows)], rows[~go(rows)]))
                return found

            leaves = [(np.arange(n), 0)]
            while p.num_leaves is None or len(leaves) < p.num_leaves:
                options = [best(*leaf) for leaf in leaves]
                i = max(range(len(leaves)), key=lambda i: options[i][0])
                if options[i][1] is None:
                    break
                depth = leaves[i][1] + 1
                leaves[i : i + 1] = [(s, depth) for s in options[i][1]]
            for rows, _ in leaves:
                d = rows[use[rows]]
                step[rows, k] = -np.sign(g[d].sum()) * max(abs(g[d].sum()) - p.l1, 0) / (h[d].sum() + p.l2) * p.learning_rate
        m = m + step
        out.append(m.copy())
    return out


PARAMS = [
    B.Params(learning_rate=0.3, num_leaves=4, min_rows=10, l1=1e-3, l2=1e-3),
    B.Params(learning_rate=0.1, num_leaves=None, max_depth=3, gamma=0.2, min_hessian=2.0),
    B.Params(learning_rate=0.3, num_leaves=5, min_rows=5, row_fraction=0.7, feature_fraction=0.7),
]


@pytest.mark.parametrize("p", PARAMS)
def test_equals_the_loop_over_rows(spark, p):
    x, y, w, held = made_up(240)
    got = B.fit(frame(spark, x, y, w, held), FEATURES, "y", p, 3, key="id", weight="w", few_parts=0)
    alike = B.fit(frame(spark, x, y, w, held), FEATURES, "y", p, 3, key="id", weight="w")
    np.testing.assert_allclose(alike.margins(alike.bins(x)), got.margins(got.bins(x)), atol=1e-9)
    want = brute(x, y, w, got.edges, p, 3, np.arange(len(y)))
    np.testing.assert_allclose(got.margins(got.bins(x)), want[-1], atol=1e-9)
    here = B.fit_local(x, y, p, 3, FEATURES, np.arange(len(y)), w, edges=got.edges)
    np.testing.assert_allclose(here.margins(here.bins(x)), want[-1], atol=1e-9)
    assert sum(len(t.feature) > 1 for r in got.rounds for t in r) >= 6
    assert p.num_leaves is None or all(sum(f < 0 for f in t.feature) <= p.num_leaves for r in got.rounds for t in r)


def test_continued_booster_goes_on_where_it_stopped(spark, tmp_path):
    x, y, w, held = made_up()
    d, p = frame(spark, x, y, w, held), B.Params(learning_rate=0.2, num_leaves=4, row_fraction=0.8)
    whole = B.fit(d, FEATURES, "y", p, B.KEEP_ROUNDS + 3, key="id")
    half = B.fit(d, FEATURES, "y", p, 4, key="id")
    B.save(half, spark, str(tmp_path / "booster"))
    again = B.fit(d, FEATURES, "y", p, B.KEEP_ROUNDS - 1, key="id", init=B.load(spark, str(tmp_path / "booster")))
    assert len(again.rounds) == len(whole.rounds) == B.KEEP_ROUNDS + 3 and again.edges == half.edges
    np.testing.assert_allclose(again.margins(again.bins(x)), whole.margins(whole.bins(x)), atol=1e-9)
    other, oy, *_ = made_up(300, 5)
    more = B.fit(frame(spark, other, oy, np.ones(300), np.zeros(300, bool)), FEATURES, "y", p, 2, init=half)
    assert more.rounds[:4] == half.rounds and len(more.rounds) == 6


def test_stops_when_held_out_rows_gain_nothing(spark):
    x, y, w, held = made_up(400, 3)
    y = np.where(held, y, np.random.default_rng(0).integers(0, 3, len(y)))  # nothing to learn from
    p = B.Params(learning_rate=0.5, num_leaves=8)
    b = B.fit(frame(spark, x, y, w, held), FEATURES, "y", p, 40, key="id", valid="held", patience=3)
    assert len(b.losses) < 40 and len(b.rounds) == int(np.argmin(b.losses)) and b.losses[-1] > min(b.losses)
    here = B.fit_local(x[~held], y[~held], p, 40, FEATURES, np.flatnonzero(~held), edges=b.edges, valid=(x[held], y[held]), patience=3)
    np.testing.assert_allclose(here.losses, b.losses, atol=1e-9)
    assert len(here.rounds) == len(b.rounds)


def test_probabilities_and_learning(spark):
    x, y, w, held = made_up(900, 7)
    d = frame(spark, x, y, w, held)
    b = B.fit(d, FEATURES, "y", B.Params(learning_rate=0.2, num_leaves=6), 15, valid="held", patience=5)
    got = B.predict(d, b).orderBy("id").collect()
    p = np.array([[r.prob_down, r.prob_flat, r.prob_up] for r in got])
    np.testing.assert_allclose(p, b.probabilities(x), atol=1e-12)
    np.testing.assert_allclose(p.sum(axis=1), 1, atol=1e-12)
    assert (p.argmax(axis=1) == y)[held].mean() > 0.65 and b.losses[-1] < b.losses[0]


def test_odd_tables(spark):
    """No rows, one class, labels that count for nothing, constant and missing features, repeated rows."""
    p = B.Params(num_leaves=4)
    none = B.fit(frame(spark, *made_up(4)).limit(0), FEATURES, "y", p, 5)
    assert none.rounds == [] and none.edges == [[], [], []]
    np.testing.assert_allclose(none.probabilities(np.full((2, 3), np.nan)), 1 / 3)
    x, y, w, held = made_up(60)
    one = B.fit(frame(spark, x, np.full(60, 2), w, held), FEATURES, "y", p, 5)
    assert (one.probabilities(x)[:, 2] > 0.4).all()
    flat = B.fit(frame(spark, np.full((60, 3), np.nan), y, w, held), FEATURES, "y", p, 3)
    assert all(len(t.feature) == 1 for r in flat.rounds for t in r)
    d = frame(spark, x, y, w, held)
    odd = B.fit(d.unionByName(d.withColumn("y", F.lit(7))).unionByName(d.withColumn("y", F.lit(None).cast("int"))), FEATURES, "y", p, 3, key="id")
    assert odd.rounds == B.fit(d, FEATURES, "y", p, 3, key="id").rounds or np.allclose(odd.probabilities(x), B.fit(d, FEATURES, "y", p, 3, key="id").probabilities(x))
    twice = B.fit(d.unionByName(d), FEATURES, "y", p, 3, key="id")
    assert len(twice.rounds) == 3
