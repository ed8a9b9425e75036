"""Series in blocks of rows, so that a series of any length spreads over tasks.

Rows get their place in their series (a range sort, and one number for each series and partition that says how many rows come before), and a
place gives a block. A block brings a halo of the rows before it, or after it, for finite frames; running sums and fills take what a block
carries in from the others, of which there is one row for each block. `windows.framed` makes every finite-frame column work on blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import stored

#: Rows of a block.
BLOCK_ROWS = 100_000
#: Spark numbers the rows of a partition from its number times 2**33.
_PART_BITS = 33


def same(a: DataFrame, b: DataFrame, names: Sequence[str], renamed: str) -> Column:
    """a.x <=> b.<renamed>x for all names: null keys are keys like others."""
    out = F.lit(True)
    for n in names:
        out &= a[n].eqNullSafe(b[f"{renamed}{n}"])
    return out


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """df with _i, the place of a row in its series from 0, _b, its block, and _last, the series' last block. Rows that are equal in keys and
    order stand in any order."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    lines = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "placed")
    runs = lines.groupBy(*keys, F.shiftright("_id", _PART_BITS).alias("_p")).agg(F.min("_id").alias("_f"), F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_c").over(Window.partitionBy(*keys))  # of one row for each series and partition
    runs = runs.withColumns({"_n": total, "_c": F.coalesce(F.sum("_c").over(before), F.lit(0))})
    runs = runs.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_p").alias("_rp"), (F.col("_c") - F.col("_f")).alias("_shift"), F.expr(f"(_n - 1) div {rows}").alias("_last"))
    met = lines.join(runs, same(lines, runs, keys, "_r_") & (F.shiftright(lines["_id"], _PART_BITS) == runs["_rp"]))
    out = met.select(*df.columns, (F.col("_id") + F.col("_shift")).alias("_i"), "_last")
    return out.withColumn("_b", F.expr(f"_i div {rows}"))


def haloed(df: DataFrame, back: int, ahead: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Placed rows with _own, and copies (not _own) of the last `back` rows of a block in the next one and of the first `ahead` rows in the one
    before. The copies are back + ahead of `rows`, which must not be fewer."""
    if max(back, ahead) > rows:
        raise ValueError("a halo must fit a block")
    at = F.pmod("_i", F.lit(rows))
    moves = F.array(F.lit(0), F.when((at >= rows - back) & (F.col("_b") < F.col("_last")), F.lit(1)), F.when((at < ahead) & (F.col("_b") > 0), F.lit(-1)))
    return df.withColumn("_d", F.explode(F.filter(moves, lambda x: x.isNotNull()))).withColumns({"_b": F.col("_b") + F.col("_d"), "_own": F.col("_d") == 0}).drop("_d")


def in_block(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_b").orderBy("_i")


def carried(df: DataFrame, keys: Sequence[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, firsts: dict[str, str] | None = None, tops: dict[str, str] | None = None) -> DataFrame:
    """df (own rows, placed) with running columns by name of the column that they run over: sums up to and with the row (nulls count for
    nothing), the last value so far, the next value from the row on (nulls skipped), and the largest value so far.

    Within a block they are windows; what comes from other blocks is a sum, last or first value for each block, carried over blocks.
    """
    sums, lasts, firsts, tops = sums or {}, lasts or {}, firsts or {}, tops or {}
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("_i"))
    totals = df.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max_by(c, known(c)).alias(f"_t_{n}") for n, c in lasts.items()], *[F.min_by(c, known(c)).alias(f"_t_{n}") for n, c in firsts.items()], *[F.max(c).alias(f"_t_{n}") for n, c in tops.items()])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums], *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts], *[F.last(f"_t_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in firsts], *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in tops]
    )
    up = in_block(keys).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_b").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumns({n: F.sum(c).over(up) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(up) for n, c in lasts.items()} | {n: F.last(c, ignorenulls=True).over(down) for n, c in firsts.items()} | {n: F.max(c).over(up) for n, c in tops.items()})
    met = run.join(carry, same(run, carry, keys, "_k_") & (run["_b"] == carry["_k_b"]), "left")
    both = lambda n: F.when(F.col(n).isNull(), F.col(f"_c_{n}")).otherwise(F.col(n) + F.coalesce(f"_c_{n}", F.lit(0.0)))
    out = met.withColumns({n: both(n) for n in sums} | {n: F.coalesce(n, f"_c_{n}") for n in (*lasts, *firsts)} | {n: F.greatest(n, f"_c_{n}") for n in tops})
    return out.drop("_k_b", *[f"_k_{k}" for k in keys], *[f"_c_{n}" for n in (*sums, *lasts, *firsts, *tops)])


def block_states(df: DataFrame, keys: Sequence[str], block_map: Callable, map_schema: str, scan: Callable, state_schema: str) -> DataFrame:
    """(keys, _b, state) that every block but a series' first begins with: `block_map` makes one row (with its number, `block`) of each block
    that another one follows, and `scan` takes a series' rows of that kind to the states after them."""
    kinds = dict(df.dtypes)
    by_key = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    keyed = lambda f: lambda key, pdf: f(pdf).assign(**dict(zip(keys, key)))
    maps = df.where("_b < _last").groupBy(*keys, "_b").applyInPandas(keyed(block_map), f"{by_key}, {map_schema}")
    return maps.groupBy(*keys).applyInPandas(keyed(scan), f"{by_key}, {state_schema}").withColumnRenamed("block", "_b")


def with_states(df: DataFrame, states: DataFrame, keys: Sequence[str], f: Callable, added: str) -> DataFrame:
    """df with the columns `added` (as a schema) that f(block's rows, its state) makes; a series' first block has an empty state."""
    names = [*df.columns, *[c.split()[0] for c in added.split(", ")]]
    schema = ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes], added])
    return df.groupBy(*keys, "_b").cogroup(states.groupBy(*keys, "_b")).applyInPandas(lambda pdf, state: f(pdf, state)[names], schema)


def plain(df: DataFrame) -> DataFrame:
    return df.drop("_i", "_b", "_last", "_own")
