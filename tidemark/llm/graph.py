"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard

MAX_ROUNDS = 60


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node's larger neighbours are tied to the smallest node it knows; second, the written table behind it.

    The smallest nodes are taken before they are shuffled, and written: a node with very many edges then meets its smallest one in a plain
    join, which adaptive execution splits.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node, and its smaller neighbours, are tied to the smallest of them (edges lead from larger to smaller nodes)."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that links reach.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows. Each round is written to the shared
    folder, so that a lost executor costs a round at most, and only a count and a checksum come to the driver.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        larger, first = _large(now)
        larger = cut(larger, "larger")
        smaller, second = _small(larger)
        now, last = cut(smaller, "edges"), now
        discard(last, first, larger, second)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
