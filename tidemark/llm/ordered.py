"""Places and running sums of rows within their groups, without a window that holds a group in one task.

Rows are dealt by range of (group, order), so that a group of any size spreads over tasks. A task numbers its own rows as they stream by.
Of all groups a partition meets, only the first can have begun in an earlier one, so one offset per partition completes the numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, cut


def numbered(df: DataFrame, group: str, order: Sequence[str], measure: Callable[[pa.RecordBatch], Sequence[int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with `_i`, the place in the group from 0, and with `_n` and `_start`, the row's measure and the sum of those before it;
    the offsets table behind them).

    Without a measure `_n` is 1. Null groups are a group of their own; rows that are equal in all of `order` stand in any order, but once
    each. Rows of an equal order key may be dealt to several partitions: `_tie` tells them apart.
    """
    names = df.columns
    inner = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]] + [F.col("_tie")]
    sorted_rows = inner.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, total = TaskContext.get().partitionId(), object(), 0, 0
        for b in batches:
            size = np.asarray(measure(b), np.int64) if measure else np.ones(b.num_rows, np.int64)
            place, start = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for k, g in enumerate(b.column(b.schema.names.index(group)).to_pylist()):
                if g != last:
                    last, at, total = g, 0, 0
                place[k], start[k] = at, total
                at, total = at + 1, total + int(size[k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place), pa.array(start), pa.array(size)], names=[*names, "_part", "_local", "_before", "_n"])

    schema = ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes], "_part int, _local bigint, _before bigint, _n bigint"])
    rows = cut(by_bytes(sorted_rows).mapInArrow(run, schema), "numbered")
    ends = rows.groupBy("_part", group).agg(F.count("*").alias("_c"), F.sum("_n").alias("_s"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_part", F.col(group).alias("_group"), F.sum("_c").over(before).alias("_c0"), F.sum("_s").over(before).alias("_s0")).where("_c0 is not null")
    first = cut(offsets, "offsets")  # at most one row for each partition
    out = rows.join(F.broadcast(first), (rows["_part"] == first["_part"]) & rows[group].eqNullSafe(first["_group"]), "left")
    return out.select(*[rows[n] for n in names], (rows["_local"] + F.coalesce(first["_c0"], F.lit(0))).alias("_i"), rows["_n"], (rows["_before"] + F.coalesce(first["_s0"], F.lit(0))).alias("_start")), first
