"""Staged runs: each stage's table is kept, and a run that broke off goes on at the first stage that is not done."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: A stage: its name, and a function of the tables of the stages before it.
Stage = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole: Spark's writers leave their mark last."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


def run_stages(spark: SparkSession, root: str, stages: Sequence[Stage], symbol_column: str | None = "symbol") -> list[tuple[str, str]]:
    """Runs the stages in order; returns (name, `cached` or `run`) of each. An error ends the run, and what was done stays."""
    tables: dict[str, DataFrame] = {}
    log = []
    for name, make in stages:
        path = f"{root}/{name}"
        done = is_done(spark, path)
        if not done:
            out = make(tables)
            writer = out.write.mode("overwrite")
            (writer.partitionBy(symbol_column) if symbol_column in out.columns else writer).parquet(path)
        tables[name] = spark.read.parquet(path)
        log.append((name, "cached" if done else "run"))
    return log
