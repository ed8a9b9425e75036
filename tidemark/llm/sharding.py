"""Extendible hashing of rows into shards that fit a byte limit, in DataFrame operations alone.

A shard is a prefix of the bits of a key's hash. A histogram of bytes by hash prefix, summed up prefix by prefix, tells which shards fit;
only an oversized one is split on another bit. The directory has an entry for each prefix of a depth that most shards have or pass; the
entry lists the few shards below it (or the one above it), and leads rows to them by one join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, pick

LIMIT_BYTES = 1 << 20
#: Bits of the hash, bits that one histogram goes beyond the even depth, and the most shards in a directory that is broadcast.
HASH_BITS, SLACK_BITS, BROADCAST_ENTRIES = 60, 4, 1 << 16


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of a key's text; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards of depth low to high among rows whose prefixes above low are oversized, and the prefixes of depth high that are too."""
    hist = rows.groupBy(_prefix("h", high).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    nodes = hist.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("p", F.expr(f"shiftright(p, {high} - d)"))
    nodes = nodes.groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("fits", F.expr(f"b <= {limit} or lo = hi"))
    nodes = cut(nodes, "nodes")
    up = nodes.select((F.col("d") + 1).alias("d"), F.col("p").alias("q"), F.col("fits").alias("up"))
    tied = nodes.withColumn("q", F.shiftright("p", 1)).join(up, ["d", "q"], "left")
    return tied.where("fits and not coalesce(up, false)").select("d", "p", "b", "c"), nodes.where(f"d = {high} and not fits").select("p")


def _directory(leaves: DataFrame, base: int) -> DataFrame:
    """(q, found): the shards (d, p, b, c) below each prefix q of `base` bits; a shallower shard stands under all its prefixes."""
    above = leaves.where(f"d < {base}").withColumn("q", F.explode(F.expr(f"sequence(shiftleft(p, {base} - d), shiftleft(p + 1, {base} - d) - 1)")))
    below = leaves.where(f"d >= {base}").withColumn("q", F.expr(f"shiftright(p, d - {base})"))
    return above.unionByName(below).groupBy("q").agg(F.collect_list(F.struct("d", "p", "b", "c")).alias("found"))


def _assign(rows: DataFrame, limit: int) -> DataFrame:
    """rows (with n_bytes and h) with leaf: the depth, prefix, bytes and rows of the shard of each."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    even = max(1, math.ceil(math.log2(max(1, total) / limit))) if total > limit else 1
    depth, base = min(HASH_BITS, even + SLACK_BITS), max(0, min(even, HASH_BITS - SLACK_BITS) - 1)
    low, todo, out = 0, rows, None
    while True:
        leaves, rest = _leaves(todo, low, depth, limit)
        leaves, rest = cut(leaves, "leaves"), cut(rest, "rest")
        directory = _directory(leaves, base)
        if base + SLACK_BITS < math.log2(BROADCAST_ENTRIES) and low == 0:
            directory = F.broadcast(directory)  # 2 ** (base + SLACK_BITS + 1) shards at most
        part = todo.withColumn("q", _prefix("h", base)).join(directory, "q").drop("q")
        part = part.withColumn("leaf", F.expr(f"get(filter(found, x -> shiftright(h, {HASH_BITS} - x.d) = x.p), 0)")).drop("found").where("leaf is not null")
        out = part if out is None else out.unionByName(part)
        if depth == HASH_BITS or rest.isEmpty():
            return out
        todo = todo.withColumn("p", _prefix("h", depth)).join(rest, "p", "left_semi").drop("p")
        low, base, depth = depth + 1, depth + 1, min(HASH_BITS, depth + 8)


_BITS = "case when leaf.d = 0 then '' else right(lpad(bin(leaf.p), 64, '0'), leaf.d) end"


def shards(df: DataFrame, key: str, size: Column, limit: int = LIMIT_BYTES) -> DataFrame:
    """key, n_bytes, depth, shard (its bits), shard_bytes, shard_rows, oversize for every row.

    Rows of one hash (a repeated key, or null keys) can't be parted: their shard is marked oversize where it passes the limit, as is one
    of a single row that does. An empty table gives no rows; null sizes count as 0.
    """
    rows = cut(df.select(F.col(key), F.coalesce(size.cast("bigint"), F.lit(0)).alias("n_bytes"), key_hash(F.col(key)).alias("h")), "rows")
    return _assign(rows, limit).select(key, "n_bytes", F.expr("cast(leaf.d as int)").alias("depth"), F.expr(_BITS).alias("shard"), F.col("leaf.b").alias("shard_bytes"), F.col("leaf.c").alias("shard_rows"), (F.col("leaf.b") > limit).alias("oversize"))


def document_shards(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of a table of texts, sized by their bytes in UTF-8; see `shards`. Null texts have none; other columns are not looked at."""
    return shards(pick(docs, key, text), key, F.octet_length(F.coalesce(F.col(text), F.lit(""))), limit)


def write_shards(df: DataFrame, path: str, key: str, size: Column, limit: int = LIMIT_BYTES) -> None:
    """Every row of df, rows with null keys too, dealt to one folder for each shard; the folder of a single shard is named for no bits."""
    rows = df.select(F.struct("*").alias("row"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("n_bytes"), key_hash(F.col(key)).alias("h"))
    _assign(rows, limit).select("row.*", F.expr(_BITS).alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
