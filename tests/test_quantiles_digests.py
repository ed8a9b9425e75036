"""Exact selection against sorted values, and digests of multisets against sums of hashes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import digests as D
from tidemark.functions.quantiles import exact_quantiles, ordered_key


def values(kind, n, rng):
    return {
        "normal": rng.standard_normal(n), "few": rng.integers(0, 3, n).astype(float), "equal": np.full(n, 4.25), "signs": np.where(rng.random(n) < 0.5, -1.0, 1.0) * 10 ** rng.uniform(-300, 300, n), "zeros": np.where(rng.random(n) < 0.6, 0.0, rng.standard_normal(n)),
        "heavy": np.concatenate([rng.standard_normal(n - 2) * 1e-9, [1e300, -1e300]]),
    }[kind]


@pytest.mark.parametrize("few", [1, 40, 20_000])
def test_quantiles_equal_those_of_the_sorted_values(spark, few):
    rng = np.random.default_rng(few)
    sets = {k: values(k, 700, rng) for k in ("normal", "few", "equal", "signs", "zeros", "heavy")} | {"one": np.array([3.0]), "two": np.array([1.0, 2.0]), None: rng.standard_normal(50)}
    rows = [(k, float(x)) for k, v in sets.items() for x in v] + [("normal", None), ("void", None)]
    at = [0.0, 0.25, 0.33, 0.5, 0.66, 1.0]
    got = {r.s: r._q for r in exact_quantiles(spark.createDataFrame(rows, "s string, x double").repartition(5), "x", at, ["s"], few, 8 if few == 1 else 4096).collect()}
    assert set(got) == set(sets)
    for k, v in sets.items():
        v = np.sort(v)
        for p, g in zip(at, got[k]):
            i = p * (len(v) - 1)
            a, b = v[int(np.floor(i))], v[int(np.ceil(i))]
            assert g == a + (b - a) * (i - np.floor(i))


def test_quantiles_of_all_rows(spark):
    d = spark.range(1001).select((F.col("id") * 1.0).alias("x"))
    assert exact_quantiles(d, "x", [0.1, 0.5], few=10).collect()[0]._q == [100.0, 500.0]
    assert exact_quantiles(d.limit(0), "x", [0.5]).count() == 0 and exact_quantiles(d.limit(0).withColumn("k", F.lit(1)), "x", [0.5], ["k"]).count() == 0


def test_keys_keep_the_order(spark):
    x = [-np.inf, -1e300, -1.5, -1e-310, 0.0, 5e-324, 1e-9, 1.0, 1.0000000000000002, 1e300, np.inf]
    got = [r.k for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", ordered_key("x").alias("k")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def brute(lines):
    return "".join(f"{sum(int(hashlib.sha256(x.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for x in lines) % 2**32:08x}" for i in range(8))


def test_digests_add_merge_and_take_away(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "a", "b"][int(rng.integers(0, 3))], f"line {int(rng.integers(0, 40))}") for _ in range(500)]
    parts = lambda some: D.digest_parts(spark.createDataFrame(some, "f string, line string"), {"f": F.col("f")}, F.col("line"))
    want = {f: brute([x for g, x in rows if g == f]) for f in "ab"}
    found = lambda d: {r.f: r.digest for r in D.hexadecimal(d, ["f"]).collect()}
    assert found(parts(rows)) == found(parts(rows[::-1])) == want
    assert found(D.merged([parts(rows[:200]), parts(rows[200:])], ["f"])) == want
    assert found(D.merged([parts(rows)], ["f"], less=parts(rows[:200]))) == found(parts(rows[200:]))
    other = found(parts([*rows[:-1], (rows[-1][0], "changed")]))
    assert {f for f in "ab" if other[f] != want[f]} == {rows[-1][0]}
