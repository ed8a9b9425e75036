"""Alignment of series: as-of joins without nested loops, floor-bucket joins, anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of a bucket of the as-of join: what one key has in a bucket is sorted by one task.
BUCKET = 86400


def asof_backward(left: DataFrame, right: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), fill: float | None = None, bucket: int = BUCKET, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each left row with the right columns of the last right row at or before its ts; of right rows of one time, the last by the columns
    named in `ties` (then by the values themselves).

    The two sides are united and sorted once within buckets of time, so that a key with very many rows is spread over tasks; the last
    right row is carried forward, its nulls with it. Rows that precede every right row of their bucket take the last one of the buckets
    before, of which there is a row for each key and bucket.
    """
    kind = f"struct<{', '.join(f'{c}:{dict(right.dtypes)[c]}' for c in columns)}>"
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket)
    order = f"struct<{', '.join(f't{i}:{dict(right.dtypes)[c]}' for i, c in enumerate((*ties, *columns)))}>"
    both = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(kind), "_o": F.lit(None).cast(order)})
    marked = right.select(*keys, "ts", F.lit(0).alias("_side"), F.struct(*columns).alias("_r"), F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate((*ties, *columns))]).alias("_o"))
    rows = both.unionByName(marked, allowMissingColumns=True).withColumn("_b", at)
    inside = Window.partitionBy(*keys, "_b").orderBy("ts", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    ends = marked.withColumn("_b", at).groupBy(*keys, "_b").agg(F.max_by("_r", F.struct("ts", "_o")).alias("_r"))
    spans = ends.unionByName(left.select(*keys, at.alias("_b")).distinct().withColumn("_r", F.lit(None).cast(kind))).groupBy(*keys, "_b").agg(F.first("_r", ignorenulls=True).alias("_r"))
    before = spans.select(*keys, "_b", F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_p"))
    out = here.join(before, [*keys, "_b"], "left").withColumn("_r", F.coalesce("_r", "_p"))
    value = lambda c: F.col(f"_r.{c}") if fill is None else F.coalesce(F.col(f"_r.{c}"), F.lit(fill))
    return out.select(*left.columns, *[value(c).alias(c) for c in columns])


def exact_then_forward(left: DataFrame, right: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Right values at equal ts only, carried forward over later left rows, 0 before the first."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = left.join(right.select(*keys, "ts", *columns), [*keys, "ts"], "left")
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})


def floor_bucket(base: DataFrame, high: DataFrame, seconds: int, name: str, keys: tuple[str, ...] = ("symbol",), lagged: bool = False) -> DataFrame:
    """Columns of the higher-timeframe candle whose bucket a row falls in (with `lagged`, of the bucket before, which is closed), carried forward."""
    cols = ["open", "high", "low", "close", "volume"]
    step = F.expr(f"interval {seconds if lagged else 0} seconds")
    up = high.select(*keys, (F.col("ts") + step).alias("_b"), *[F.col(c).alias(f"agg_{name}_{c}") for c in cols], (F.col("high") - F.col("low")).alias(f"agg_{name}_hl_range"))
    out = base.withColumn("_b", F.window("ts", f"{seconds} seconds").start).join(up, [*keys, "_b"], "left").drop("_b")
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in [f"agg_{name}_{x}" for x in [*cols, "hl_range"]]})
