"""Exact Jaccard self-join on word shingles by grouped prefixes.

A set that shares 90 % with another shares at least one of its first tenth of shingles, in any order common to all documents. Shingles are
ordered by a sketch of how many documents hold them, rare ones first. Documents of equal sets are one class; classes of equal prefix and
size are one group, and only groups are compared. The groups of a shingle are first tied to its hubs (the groups with most copies of HUBS
parts, dealt by hash), and the classes of a group to its smallest; pairs of classes, of two groups or of one, that these verified links
have not brought together are then expanded, among sizes that can be similar, and verified one and all, so no link between two components
is missed, while a group of many near copies never yields all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, texts
from tidemark.llm.graph import components

WORDS, PERCENT, HUBS = 3, 90, 2
#: log2 of the counters of the document-frequency sketch, and of the most bits of the filter of wanted ids (it has 16 for each of them)
SKETCH_BITS, FILTER_BITS = 22, 28
#: Bits of a posting's place and of its size: a text of 2 GB, the longest that Spark holds, has fewer than 2 ** 30 words.
POS_BITS, SIZE_BITS = 27, 30

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(h: np.ndarray, by: np.uint64 = _M4) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * by
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, none has none."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join([b"%d" % n, *found]))], np.uint64) if n else np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    out = h[: n - words + 1].copy()
    for i in range(1, words):
        out = mixed(out * _M1 + h[i : n - words + 1 + i] * _M2 + _M3)
    return np.unique(out)


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(h, _M2) >> np.uint64(64 - bits)).astype(np.int64)


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold each of them."""
    top = int(counts.max(initial=0))
    return counts.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if top < 1 << 8 * w)).tobytes()


def widened(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, f"<u{len(counts) // n}").astype(np.int64)


def frequency_rank(docs: DataFrame, key: str, text: str, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """A byte for each counter: about four times the logarithm of the documents that hold its shingles. 2 ** bits bytes, whatever the input;
    a byte tells counts up to 2 ** 63 apart, so very common shingles stay last in the order of a corpus of any size.

    Tasks count by themselves; their counters are added up block by block, in two steps where there are many tasks, and only the bytes
    come to the driver. Any such table gives an exact join; a truer one makes it cheaper. A group of blocks goes to Python whole, and its
    rows are sorted uncompressed: blocks are small, and their counters as narrow as they can be.
    """
    size, block = 1 << bits, 1 << min(bits, 14)
    source = texts(docs, key, text).select(text)
    subs = -(-source.rdd.getNumPartitions() // 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        held, waiting = [], 0

        def add() -> None:
            np.add(total, np.bincount(_buckets(np.concatenate(held), bits), minlength=size), out=total, casting="unsafe")
            held.clear()

        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                held.append(s)
                waiting += len(s)
                if waiting > 1_000_000:
                    add()
                    waiting = 0
        if held:
            add()
        sub = TaskContext.get().partitionId() % subs
        for i in range(0, size, block):
            yield pa.RecordBatch.from_arrays([pa.array([i // block], pa.int32()), pa.array([sub], pa.int32()), pa.array([narrow(total[i : i + block])], pa.binary())], names=["block", "sub", "counts"])

    def add_up(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros(block, np.int64)
        for c in pdf["counts"]:
            total += widened(c, block)
        return total

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [narrow(add_up(pdf))]})

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "ranks": [np.minimum(255, 4 * np.log2(1 + add_up(pdf))).astype(np.uint8).tobytes()]})

    parts = source.mapInArrow(count, "block int, sub int, counts binary")
    if subs > 1:
        parts = parts.groupBy("block", "sub").applyInPandas(some, "block int, counts binary")
    table = np.zeros(size, np.uint8)
    for r in parts.groupBy("block").applyInPandas(ranked, "block int, ranks binary").collect():  # size bytes in all
        table[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["ranks"], np.uint8)
    return table


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _two_sums(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    return int(_signed(np.add.reduce(mixed(h, _M1), keepdims=True))[0]), int(_signed(np.add.reduce(mixed(h, _M3), keepdims=True))[0])


def signatures(docs: DataFrame, rank: np.ndarray, key: str, text: str, words: int, percent: int) -> DataFrame:
    """id, set size n, two sums for the set (s1, s2) and for its prefix (g1, g2), and the prefix; one row per document."""
    bits = len(rank).bit_length() - 1
    ranks = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                h = shingles(t.as_py(), words)
                n = len(h)
                if not n:
                    for c, v in zip(out, (0, 0, 0, 0, 0, np.empty(0, np.int64))):
                        c.append(v)
                    continue
                order = np.argsort(table[_buckets(h, bits)], kind="stable")  # h is sorted: ties by hash
                first = h[order[: prefix_length(n, percent)]]
                for c, v in zip(out, (n, *_two_sums(h), *_two_sums(first), _signed(first))):
                    c.append(v)
            sizes = np.cumsum([0, *map(len, out[5])])
            flat = np.concatenate(out[5]) if out[5] else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:5]], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))], names=["id", "n", "s1", "s2", "g1", "g2", "prefix"])

    kind = dict(docs.dtypes)[key]
    return texts(docs, key, text).mapInArrow(run, f"id {kind}, n bigint, s1 bigint, s2 bigint, g1 bigint, g2 bigint, prefix array<bigint>")


def wanted_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, shingles) of at least the documents whose id is in ids: a bit filter of at most 2 ** FILTER_BITS bits picks them while the table streams by."""
    bits, kind = min(FILTER_BITS, max(16, (16 * ids.count()).bit_length())), dict(docs.dtypes)[key]
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    rows = ids.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map")).collect()  # 2 ** bits bits at most
    if not rows:
        return docs.sparkSession.createDataFrame([], f"id {kind}, set array<bigint>")
    table = np.zeros(1 << bits >> 3, np.uint8)
    per = 4096
    for r in rows:
        at = (r["bucket"] - 1) * per
        part = np.frombuffer(r["map"], np.uint8)[: len(table) - at]
        table[at : at + len(part)] |= part
    bitmap = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bitmap.value
        for b in batches:
            p = b.column(2).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(t[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            for a in range(0, len(keep), 500):
                at = keep[a : a + 500]
                sets = [_signed(shingles(b.column(1)[int(i)].as_py(), words)) for i in at]
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat, pa.int64()))], names=["id", "set"])

    source = texts(docs, key, text).select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null").withColumn("p", place)
    return source.mapInArrow(run, f"id {kind}, set array<bigint>")


def sets_of(docs: DataFrame, pairs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Shingle sets of the documents that stand in a pair."""
    return wanted_sets(docs, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")), key, text, words)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    inter = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", inter).where(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _possible(percent: int) -> str:
    """Sizes and places of two groups' first common prefix shingle allow the similarity."""
    return f"100 * least(n, hn) >= {percent} * greatest(n, hn) and {100 + percent} * least(n - pos, hn - hpos) >= {percent} * (n + hn)"


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, hubs: int = HUBS) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links reach) for every row; see the module.

    Two rows link when 100 * |A & B| >= percent * |A | B| of their shingle sets. Null and empty texts have size 0 and link with nothing.
    Rows that share a key are one node; rows without a key link with nothing and have no component. Hashes have 64 bits, signatures 128.
    """
    rank = frequency_rank(docs, key, text, words)
    base = cut(signatures(docs, rank, key, text, words, percent), "signatures", free=True)
    live = base.where("n > 0 and id is not null")
    classes = cut(live.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.first("g1").alias("g1"), F.first("g2").alias("g2")), "classes")
    groups = live.groupBy("g1", "g2", "n").agg(F.min("id").alias("gid"), F.count("*").alias("copies"), F.min_by("prefix", "id").alias("prefix"))
    # one number holds the logarithm of the copies, the size and the place: it is half of what the widest shuffle moves
    meta = F.expr(f"shiftleft(cast(log2(copies) as bigint), {POS_BITS + SIZE_BITS}) + shiftleft(n, {POS_BITS})")
    postings = groups.withColumn("meta", meta).select("gid", "meta", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", (F.col("meta") + F.col("pos")).alias("meta"))
    common = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    parts = [F.expr(x) for x in (f"shiftright(meta, {POS_BITS + SIZE_BITS}) as copies", f"shiftright(meta, {POS_BITS}) & {(1 << SIZE_BITS) - 1} as n", f"cast(meta & {(1 << POS_BITS) - 1} as int) as pos")]
    shared = cut(postings.join(common, "token").select("token", "gid", *parts), "postings", free=True)
    ids = cut(base.select("id", "n", "s1", "s2"), "ids", free=True)
    discard(base)

    many = classes.groupBy("g1", "g2", "n").agg(F.min("rep").alias("gid"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = cut(classes.join(many, ["g1", "g2", "n"]).select("gid", "rep"), "members")
    # a hub for each part: maxima are taken before the shuffle, however many groups a shingle has
    hub = F.struct("copies", F.xxhash64("gid").alias("h"), F.col("gid").alias("hub"), F.col("n").alias("hn"), F.col("pos").alias("hpos"))
    hubs_of = F.array(*[F.max(F.when(F.pmod(F.xxhash64("gid", F.lit(1)), F.lit(hubs)) == i, hub)) for i in range(hubs)])
    # written, so that the join with all groups of a shingle has no aggregate in its stage and adaptive execution can split it
    top = cut(shared.groupBy("token").agg(hubs_of.alias("x")).withColumn("x", F.explode("x")).where("x is not null").select("token", "x.hub", "x.hn", "x.hpos"), "hubs", free=True)
    first = shared.join(top, "token").where(f"gid <> hub and {_possible(percent)}").select(F.least("gid", "hub").alias("a"), F.greatest("gid", "hub").alias("b"))
    tied = cut(first.unionAll(members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))).distinct(), "pairs")
    sets = cut(sets_of(docs, tied, key, text, words), "sets", free=True)
    links = cut(verified(tied, sets, percent), "links", free=True)
    discard(sets, top)
    so_far = cut(components(links), "components")

    expanded = shared.join(members, "gid", "left").withColumn("rep", F.coalesce("rep", "gid"))
    labelled = cut(expanded.join(so_far.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("comp")), "labelled")
    discard(shared)
    apart = cut(labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token"), "apart")
    # sizes that can be similar lie in the same band or in the next: a common shingle's groups meet only there
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    rest = cut(labelled.join(apart, "token").withColumn("band", band), "rest", free=True)
    discard(labelled, apart)
    larger = rest.select("token", "band", F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("pos").alias("hpos"), F.col("comp").alias("hcomp"))
    smaller = rest.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    open_pairs = smaller.join(larger, ["token", "band"]).where(f"comp <> hcomp and n <= hn and {_possible(percent)}").select("rep", "hub")
    # classes of one group have all their prefix in common: they meet by their group, also where no other group holds any of its shingles
    inside = cut(members.join(so_far.withColumnRenamed("node", "rep"), "rep", "left").select("gid", "rep", F.coalesce("component", "rep").alias("comp")), "inside")
    split = inside.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
    divided = cut(inside.join(split, "gid"), "divided")
    within = divided.join(divided.select("gid", F.col("rep").alias("hub"), F.col("comp").alias("hcomp")), "gid").where("comp < hcomp").select("rep", "hub")
    open_pairs = open_pairs.unionAll(within).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    left = cut(open_pairs.join(tied, ["a", "b"], "left_anti"), "pairs", free=True)
    discard(rest, tied, inside, divided, members, so_far)
    sets = cut(sets_of(docs, left, key, text, words), "sets")
    more = cut(verified(left, sets, percent), "links", free=True)
    discard(sets, left)
    final = cut(components(links.unionAll(more)), "components")
    discard(links, more)

    node = final.withColumnRenamed("node", "rep")
    named = cut(classes.join(node, "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component")), "named")
    discard(classes, final)
    out = ids.join(named, ["s1", "s2", "n"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component_id"))
