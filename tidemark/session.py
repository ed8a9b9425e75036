"""Sessions with the settings that the engine's results rely on, and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere; the rest are Spark's adaptive defaults made explicit.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("tidemark")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the session's checkpoint folder, which all machines share. Where none is set, a local session gets a temporary
    one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """df, written as Parquet and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
