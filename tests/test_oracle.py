"""Every query with a twin against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d:
        if d[c].dtype == object:
            d[c] = d[c].map(lambda v: repr(v.tolist()) if isinstance(v, np.ndarray) else None if v is None or v is pd.NaT or v != v else str(v))
        elif "datetime" in str(d[c].dtype):
            d[c] = d[c].astype("datetime64[us]").astype(str)
        else:
            d[c] = d[c].astype(float)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, duck, name):
    got, want = norm(QUERIES[name](spark, SF).toPandas()), norm(duck.execute(ORACLE_SQL[name]).df())
    assert list(got) == list(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
