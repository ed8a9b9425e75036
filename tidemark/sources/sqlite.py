"""SQLite files in the shared folder: one task at a time writes, and tasks side by side read."""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import scratch

#: Column types of SQLite; other types are kept as text.
TYPES = {"boolean": "INTEGER", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
#: Rows of a batch that comes back, and seconds that a writer waits for another.
ROWS, WAIT = 10_000, 600


def database(spark: SparkSession, label: str) -> str:
    """The path of a fresh database file, which driver and executors share."""
    path = re.sub("^file:(//)?(?=/)", "", scratch(spark, label)) + ".db"
    if not path.startswith("/"):
        raise RuntimeError(f"a SQLite file needs a folder that all machines have mounted, not {path}")
    return path


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    """SQLite keeps booleans as numbers."""
    return pa.array(values, pa.int64()).cast(kind) if pa.types.is_boolean(kind) else pa.array(values, kind)


def append(df: DataFrame, path: str, table: str) -> int:
    """Appends the rows, creating the table if need be; their number.

    SQLite has one writer, so the rows go to one task, after the stages that make them, and in one transaction. A mark in the same
    transaction keeps a task that runs again from writing twice.
    """
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    plain = df.select(*[name(c) if t in TYPES else name(c).cast("string").alias(c) for c, t in df.dtypes])
    columns = ", ".join(f"{quoted(c)} {TYPES.get(t, 'TEXT')}" for c, t in df.dtypes)
    mark, width = uuid.uuid4().hex, len(df.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        to = sqlite3.connect(path, timeout=WAIT, isolation_level=None)
        try:
            to.execute("BEGIN IMMEDIATE")
            to.execute("CREATE TABLE IF NOT EXISTS _appended (mark TEXT PRIMARY KEY, n INTEGER)")
            done = to.execute("SELECT n FROM _appended WHERE mark = ?", (mark,)).fetchone()
            n = done[0] if done else 0
            if not done:
                to.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns})")
            for b in batches:
                if not done:
                    to.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * width)})", zip(*[c.to_pylist() for c in b.columns]))
                    n += b.num_rows
            if not done:
                to.execute("INSERT INTO _appended VALUES (?, ?)", (mark, n))
            to.execute("COMMIT")
        finally:
            to.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return plain.repartition(1).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def scan(spark: SparkSession, path: str, text: str, schema: str, column: str | None = None, bounds: Sequence[int] = ()) -> DataFrame:
    """The rows of SQL text that the database runs, with the types of the schema: from one task, or, given a column of the result and
    bounds, from one task for each range that the bounds part (nulls are in the first)."""
    types = to_arrow_schema(StructType.fromDDL(schema))
    c, parts = quoted(column or ""), [text]
    if column and bounds:
        low = [f"{c} < {bounds[0]!r} OR {c} IS NULL", *[f"{c} >= {a!r} AND {c} < {b!r}" for a, b in zip(bounds, bounds[1:])], f"{c} >= {bounds[-1]!r}"]
        parts = [f"SELECT * FROM ({text}) WHERE {x}" for x in low]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                of = sqlite3.connect(path, timeout=WAIT)
                try:
                    found = of.execute(parts[i])
                    while rows := found.fetchmany(ROWS):
                        yield pa.RecordBatch.from_arrays([_array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)
                finally:
                    of.close()

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, schema)
