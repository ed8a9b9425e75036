"""Database files of sessions whose executors are processes of their own, and their odd rows."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from tidemark.sources import sqlite

REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
CODE = f"""
import duckdb
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://" + FOLDER + "/shared").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", FOLDER + "/warehouse").getOrCreate()
from tidemark.plans.registry import ORACLE_SQL, QUERIES
duck = duckdb.connect()
for t in ("orders", "events"):
    duck.execute("create view " + t + " as select * from '{SF}/" + t + ".parquet'")
for name in ("scan_sqlite", "sink_sqlite_append"):
    got, want = QUERIES[name](spark, "{SF}"), duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got, want = sorted(map(tuple, got.select(*names).collect())), sorted(want.fetchall())
    assert len(got) == len(want) and all(x[:-1] == y[:-1] and abs(x[-1] - y[-1]) < 2e-6 for x, y in zip(got, want)), (name, got[:3], want[:3])
print("equal")
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_on_a_cluster(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # executors' logs go to work in Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": os.pathsep.join([str(REPO), *filter(None, sys.path)]), "PYTHONDONTWRITEBYTECODE": "1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", f"FOLDER = {str(tmp_path)!r}\n{CODE}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.endswith("equal\n"), done.stderr[-2000:]


def test_rows_appended_and_read(spark):
    to = sqlite.database(spark, "odd")
    schema = 'k bigint, `a "b` string, x double, ok boolean'
    rows = [(None, 'it\'s "x"', 1.5, True), (-5, None, None, None), (0, "", -0.0, False), (9, "ä", 1e300, True)]
    assert sqlite.append(spark.createDataFrame(rows[:2], schema), to, "t") == 2
    assert sqlite.append(spark.createDataFrame(rows[2:], schema).repartition(3), to, "t") == 2
    assert sqlite.append(spark.createDataFrame([], schema), to, "t") == 0
    back = sqlite.scan(spark, to, "SELECT * FROM t", schema, "k", [0, 9])
    assert back.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sqlite.scan(spark, to, "SELECT count(*) FROM t WHERE k >= 0", "n int").first()[0] == 2
