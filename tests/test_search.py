"""Nearest neighbours against a comparison with all rows: dense cells, ties, repeats, odd vectors, small blocks."""

import numpy as np
import pytest

from tidemark.operators.search import EPS, Search, recall


def vectors(n=1500, dim=12, seed=4):
    """A third of the rows lie close together, some are equal, the rest is spread out."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[: n // 3] = x[0] + 0.05 * rng.standard_normal((n // 3, dim))
    x[40:60] = x[40]
    return x


def frame(spark, x, more=()):
    return spark.createDataFrame([*[(i, [float(v) for v in r]) for i, r in enumerate(x)], *more], "vec_id bigint, embedding array<double>").repartition(5)


def brute(x, q, k, by):
    out = {}
    for i in q:
        if by == "l2":
            s = ((x - x[i]) ** 2).sum(axis=1)
            order = np.lexsort((np.arange(len(x)), s))[:k]
        else:
            norm = np.sqrt((x * x).sum(axis=1)) + EPS
            s = x @ x[i] / (norm * norm[i])
            order = sorted(range(len(x)), key=lambda j: (-round(s[j], 12), j))[:k]
        out[i] = [(int(j), s[j]) for j in order]
    return out


@pytest.mark.parametrize("by", ["l2", "cosine"])
@pytest.mark.parametrize("blocks", [(70, 9), (20_000, 1_000)])
def test_equals_the_comparison_with_all_rows(spark, by, blocks):
    x = vectors()
    d = frame(spark, x)
    index = Search(d, by, cells=16, row_block=blocks[0])
    q = d.where("vec_id % 20 = 0")
    got = {}
    for r in index.top_k(q, 6, query_block=blocks[1]).collect():
        got.setdefault(r._query, []).append((r.place, r._id, r.score))
    want = brute(x, range(0, len(x), 20), 6, by)
    assert set(got) == set(want)
    for i, rows in want.items():
        mine = [(j, s) for _, j, s in sorted(got[i])]
        np.testing.assert_allclose([s for _, s in mine], [s for _, s in rows], atol=1e-9)
        assert by == "cosine" or [j for j, _ in mine] == [j for j, _ in rows]


def test_recall_of_the_first_cells(spark):
    """On clustered vectors the nearest cells alone find nearly all; the second step finds the rest."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((40, 16)) * 4, 50, axis=0) + rng.standard_normal((2000, 16))
    d = frame(spark, x)
    index, q = Search(d, cells=32), d.where("vec_id % 20 = 0")
    whole = index.top_k(q, 5)
    first = recall(index.top_k(q, 5, exact=False), whole)
    print("recall of 4 of 32 cells:", first)
    assert first >= 0.9 and recall(whole, whole) == 1.0
    want = brute(x, range(0, 2000, 20), 5, "l2")
    assert {(r._query, r._id) for r in whole.collect()} == {(i, j) for i, rows in want.items() for j, _ in rows}


def test_odd_vectors_and_small_tables(spark):
    odd = [(100, None), (101, []), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [float("inf"), 0.0]), (105, [1.0])]
    d = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]]), odd)
    got = Search(d).top_k(d, 5).collect()
    assert {(r._query, r._id) for r in got} == {(i, j) for i in range(3) for j in range(3)}
    assert [r._id for r in sorted((r for r in got if r._query == 1), key=lambda r: r.place)] == [1, 2, 0]
    assert Search(d.limit(0)).top_k(d, 5).count() == 0 and Search(d).top_k(d.limit(0), 5).count() == 0
    assert Search(d, "cosine").top_k(d, 1).count() == 3
