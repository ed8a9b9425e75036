"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (name, Spark DDL type, Arrow type)
Field = tuple[str, str, pa.DataType]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact spelling: other columns may bear any name, even one that differs in case only."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_in{at[n]}").alias(n) for n in names])


#: Rows of an Arrow batch that goes to Python, at most. Spark bounds such batches by rows alone, so few rows keep long texts in bounds.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 128


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_ROWS rows at most, or fewer if the session has it so.

    Spark reads the setting when a plan runs, so it stays. It is a bound of memory alone: results do not depend on it.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_KEY)) <= BATCH_ROWS:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return df


#: Bytes of an Arrow batch, at most (or one row), where rows may be many and short.
BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def by_bytes(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_BYTES at most, or fewer if the session has it so; its rows by batch are left alone."""
    conf = df.sparkSession.conf
    size, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", conf.get(BYTES_KEY).lower()).groups()
    if not 0 < int(size) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        conf.set(BYTES_KEY, str(BATCH_BYTES))
    return df


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the text, for a Python step, in bounded batches."""
    return bounded(pick(df, key, text).withColumn(text, F.col(text).cast("string")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "cut", free: bool = False, clean: bool = False, codec: str = "snappy") -> DataFrame:
    """The rows of df, written to the shared folder and read back: later steps neither recompute them nor need the executors that made them.

    Once the rows are written, the shuffle files behind them serve nothing. They go when the driver collects its garbage; `free` has it do
    so at once, which large steps need, and with `clean` Spark itself deletes them as the write ends. `discard` deletes the table when its
    successor is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP_KEY, "false")
    if clean:
        spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if clean:
            spark.conf.set(CLEANUP_KEY, before)
    if free or clean:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_texts(df: DataFrame, text: str, fields: Sequence[Field], fn: Callable[[list], Sequence[list]]) -> DataFrame:
    """df with the columns that fn makes of a batch of texts (None: null). Only the texts go to Python, and only fn's columns come back."""
    types, names = [f[2] for f in fields], [f[0] for f in fields]

    @F.arrow_udf(", ".join(f"`{n}` {t}" for n, t, _ in fields))
    def run(batch: pa.Array) -> pa.Array:
        cols = fn(batch.to_pylist())
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return bounded(df).withColumn("_made", run(F.col(text).cast("string"))).select(*df.columns, *[F.col("_made")[n].alias(n) for n in names])


def map_texts(df: DataFrame, key: str, text: str, fields: Sequence[Field], fn: Callable[[list], Sequence[list]]) -> DataFrame:
    """One row out per row in, without a shuffle: the key as it was, and the columns that fn makes of a batch of texts (None: null)."""
    kind = dict(df.dtypes)[key]
    names = [key, *[f[0] for f in fields]]
    types = [f[2] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = fn(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=t) for c, t in zip(cols, types)]], names=names)

    schema = ", ".join([f"`{key}` {kind}", *[f"`{n}` {t}" for n, t, _ in fields]])
    return texts(df, key, text).mapInArrow(run, schema)
