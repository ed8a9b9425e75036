"""Digests of multisets of lines that don't depend on an order: sums of wide hashes, so parts can be added, taken away and merged.

A line's SHA-256 is eight 32-bit limbs; a multiset's digest is their sums, each modulo 2**32. Tasks add up their own lines, and what is
shuffled is one row for each key and task. Equal lines count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS, MODULUS = 8, 1 << 32
NAMES = [f"_h{i}" for i in range(LIMBS)]


def digest_parts(df: DataFrame, keys: dict[str, Column], line: Column) -> DataFrame:
    """The keys and a digest's limbs for each of them; null lines count for nothing."""
    hashed = df.select(*[c.alias(k) for k, c in keys.items()], F.sha2(line.cast("binary"), 256).alias("_s"))
    limb = lambda i: F.conv(F.substring("_s", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    return hashed.groupBy(*keys).agg(*[_wrapped(F.sum(limb(i))).alias(n) for i, n in enumerate(NAMES)])


def _wrapped(x: Column) -> Column:
    return F.pmod(F.coalesce(x, F.lit(0)), F.lit(MODULUS)).cast("bigint")


def merged(parts: Sequence[DataFrame], keys: Sequence[str], less: DataFrame | None = None) -> DataFrame:
    """The digest of all parts' lines together, less the lines of another one."""
    rows = reduce(DataFrame.unionByName, [p.select(*keys, *NAMES) for p in parts])
    if less is not None:
        rows = rows.unionByName(less.select(*keys, *[(-F.col(n)).alias(n) for n in NAMES]))
    return rows.groupBy(*keys).agg(*[_wrapped(F.sum(F.col(n).cast("decimal(20,0)"))).alias(n) for n in NAMES])


def hexadecimal(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys and the digest as 64 hexadecimal digits."""
    return parts.select(*keys, F.concat(*[F.lpad(F.lower(F.hex(F.col(n))), 8, "0") for n in NAMES]).alias("digest"))
