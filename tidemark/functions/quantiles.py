"""Exact quantiles by selection: ranges of order-preserving keys are narrowed by histograms, until few rows are left in each.

A pass counts the rows of every range by bucket and keeps the bucket that holds the wanted place; the memory of a task and of the shuffle
depends on the numbers of series, quantiles and buckets, not on the number of rows or of distinct values. Six passes narrow 64-bit keys to
single values; a range of few rows is sorted before that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

#: Buckets of a range in a pass, and rows that are sorted as they are.
BUCKETS, FEW = 4096, 20_000


def ordered_key(x: str) -> Column:
    """A 64-bit number in the order of a double: its bits, the lower ones of negative numbers turned over."""
    bits = F.expr(f"cast(java_method('java.lang.Double', 'doubleToLongBits', {x}) as bigint)")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def exact_quantiles(df: DataFrame, column: str, at: Sequence[float], keys: Sequence[str] = (), few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """One row per series (keys; none: all rows) with _q, the quantiles `at` between the two nearest places, as percentile has them.

    Nulls are left out; a series without values has no row; null keys are a series. The rows are stored once and read in every pass.
    """
    by = [f"_k{i}" for i in range(len(keys))]
    picked = df.where(F.col(column).isNotNull()).select(*[F.col(k).alias(b) for k, b in zip(keys, by)], (F.col(column).cast("double") + 0.0).alias("_x"))
    rows = stored(picked.select(*by, "_x", ordered_key("_x").alias("_key")), "quantiles")
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")).where("_n > 0")
    # the two places of every quantile; ranks of equal places are narrowed together
    places = F.array_distinct(F.flatten(F.array(*[F.array(*[f(F.lit(float(p)) * (F.col("_n") - 1)).cast("bigint") for f in (F.floor, F.ceil)]) for p in at])))
    ranges = stored(ends.select(*by, F.explode(places).alias("_rank"), F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_in"), "_lo", "_hi"), "ranges")
    wide = F.col("_in") > few
    same = lambda a, b: [a[k].eqNullSafe(b[f"r{k}"]) for k in by]
    renamed = lambda d: d.select(*[F.col(k).alias(f"r{k}") for k in by], "_rank", "_below", "_in", "_lo", "_hi")

    def inside(targets: DataFrame) -> DataFrame:
        """Every row once for each range that holds it; ranges of a series are few."""
        r = renamed(targets).groupBy(*[f"r{k}" for k in by]).agg(F.collect_list(F.struct("_rank", "_below", "_in", "_lo", "_hi")).alias("_r"))
        met = rows.join(r, same(rows, r)) if by else rows.join(F.broadcast(r))  # one row without keys
        hit = met.select(*by, "_x", "_key", F.explode(F.filter("_r", lambda t: (met["_key"] >= t["_lo"]) & (met["_key"] <= t["_hi"]))).alias("t"))
        return hit.select(*by, "_x", "_key", "t.*")

    while ranges.where(wide & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        open_ = ranges.where(wide & (F.col("_lo") < F.col("_hi")))
        width = f"(_hi div {buckets} - _lo div {buckets} + 1)"
        cells = inside(open_).groupBy(*by, "_rank", "_below", F.expr(f"_key div {width} - _lo div {width}").alias("_b")).agg(F.count("*").alias("_in"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
        upto = Window.partitionBy(*by, "_rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        cum = cells.withColumn("_upto", F.col("_below") + F.sum("_in").over(upto)).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_in") <= F.col("_rank")))
        narrowed = cum.select(*by, "_rank", (F.col("_upto") - F.col("_in")).alias("_below"), "_in", "_lo", "_hi")
        ranges = stored(ranges.where(~wide | (F.col("_lo") == F.col("_hi"))).unionByName(narrowed), "ranges")
    # single values need no more than their key; others have at most `few` rows, which are sorted
    left = inside(ranges)
    one = F.min("_x")
    listed = F.element_at(F.sort_array(F.collect_list(F.when((F.col("_in") <= few) & (F.col("_lo") < F.col("_hi")), F.col("_x")))), (F.first("_rank") - F.first("_below") + 1).cast("int"))
    values = left.groupBy(*by, "_rank").agg(F.when(F.first("_lo") == F.first("_hi"), one).otherwise(listed).alias("_v"))
    table = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))
    counted = ends.select(*[F.col(k).alias(f"c{k}") for k in by], "_n")
    met = table.join(counted, [table[k].eqNullSafe(counted[f"c{k}"]) for k in by]) if by else table.join(F.broadcast(counted))

    def value(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col("_m")[F.floor(place).cast("bigint")], F.col("_m")[F.ceil(place).cast("bigint")]
        return low + (high - low) * (place - F.floor(place))

    return met.select(*[F.col(b).alias(k) for k, b in zip(keys, by)], F.array(*[value(p) for p in at]).alias("_q"))
