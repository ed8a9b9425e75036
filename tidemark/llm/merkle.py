"""Merkle manifest of a table: a leaf for each row, a tree for each group, a root over the groups' roots, and a proof for each row.

Superblock reduction: the nodes of a group, numbered from 0, fall into buckets of fanout^k, and one applyInPandas call collapses the k
levels of a bucket, noting every node's siblings on the way. The buckets' roots are nodes of the next round, until a group is one node; a
row's proof is the path in its bucket followed by that of its bucket's root. A round leaves one node in fanout^k, so a few suffice.

A path is text: `left.right,` for each level, where left and right are the digests of the siblings before and after the node, joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, pick
from tidemark.llm.ordered import numbered

#: Children of a node, and levels that one bucket collapses (1,024 nodes).
FANOUT, LEVELS = 2, 10


def sized(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes of the text form, a colon and the text form."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[sized(v) for v in values]), 256)


def levels_of(digests: list[str], fanout: int, most: int | None) -> list[list[str]]:
    """The nodes by level, from the given ones up to a single node, or over `most` levels whatever their nodes."""
    out = [digests]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        d = out[-1]
        out.append([hashlib.sha256("".join(d[i : i + fanout]).encode()).hexdigest() for i in range(0, len(d), fanout)])
    return out


def paths_of(levels: list[list[str]], fanout: int) -> list[str]:
    """The path of every node of the lowest level to the top of `levels`."""
    above = [""] * len(levels[-1])
    for d in reversed(levels[:-1]):
        here = []
        for i in range(len(d)):
            a = i - i % fanout
            here.append(f"{''.join(d[a:i])}.{''.join(d[i + 1 : a + fanout])},{above[i // fanout]}")
        above = here
    return above


def collapse(nodes: DataFrame, group: str, fanout: int, levels: int) -> DataFrame:
    """nodes(group, _i, _digest) with _bucket, _path within the bucket and _top, the bucket's root.

    A bucket that is not full and the first of its group is the whole group and collapses to one node. Every other bucket collapses
    `levels` levels: if it is full that is the same, and if it is the last of several, its lone nodes are digested like others.
    """
    width = fanout**levels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", kind="stable")
        whole = pdf["_bucket"].iat[0] == 0 and len(pdf) < width
        tree = levels_of(pdf["_digest"].tolist(), fanout, None if whole else levels)
        return pdf.assign(_path=paths_of(tree, fanout), _top=tree[-1][0])

    kind = dict(nodes.dtypes)[group]
    dealt = nodes.select(group, "_i", "_digest", F.expr(f"_i div {width}").alias("_bucket"))
    return dealt.groupBy(group, "_bucket").applyInPandas(run, f"`{group}` {kind}, _i bigint, _digest string, _bucket bigint, _path string, _top string")


def reduced(nodes: DataFrame, group: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(group, _i, _path to the group's root, _root) for every node(group, _i, _digest); `group` must be a string column."""
    done = cut(collapse(nodes, group, fanout, levels), "buckets")
    width = fanout**levels
    if not done.where("_bucket > 0").limit(1).count():
        return done.select(group, "_i", "_path", F.col("_top").alias("_root"))
    roots = done.where(f"_i = _bucket * {width}").select(group, F.col("_bucket").alias("_i"), F.col("_top").alias("_digest"))
    up = reduced(roots, group, fanout, levels).select(F.col(group).alias("_g"), F.col("_i").alias("_b"), F.col("_path").alias("_upper"), "_root")
    met = done.join(up, (done["_bucket"] == up["_b"]) & done[group].eqNullSafe(up["_g"]))
    return met.select(group, "_i", F.concat("_path", "_upper").alias("_path"), "_root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    steps = F.filter(F.split(path, ","), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(F.substring_index(s, ".", 1), acc, F.substring_index(s, ".", -1)), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.translate(path, ".,", "")


def manifest(docs: DataFrame, fields: Sequence[str], key: str, group: str, fanout: int = FANOUT, levels: int = LEVELS, altered: Column | None = None, altered_fields: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, altered_leaf, path, subroot, root) for every row.

    A leaf is the digest of `fields` in order. Leaves of a group ascend by key (null keys first; equal keys by leaf, and rows equal in all
    fields are interchangeable); null groups are a group of their own and the first one. `altered` tells for which rows a second leaf is
    made, in which `altered_fields` stand for the fields of those names; for other rows it is the leaf. Null values and empty texts have
    leaves of their own (`-` and `0:`); other columns are not read; an empty table has no rows.
    """
    base = pick(docs, *dict.fromkeys([key, group, *fields]))
    kind = dict(base.dtypes)[key]
    leaf = leaf_digest([F.col(c) for c in fields])
    other = leaf_digest([(altered_fields or {}).get(c, F.col(c)) for c in fields])
    made = base.select(F.col(key).alias("_key"), F.col(group).cast("string").alias("_group"), leaf.alias("_digest"), (F.when(altered, other) if altered is not None else F.lit(None).cast("string")).alias("_other"))
    leaves = cut(made, "leaves")
    rows, _ = numbered(leaves, "_group", ["_key", "_digest"])
    placed = cut(rows.select("_key", "_group", "_digest", "_other", "_i"), "placed")
    discard(leaves)
    trees = cut(reduced(placed.select("_group", "_i", "_digest"), "_group", fanout, levels), "trees")
    tops = cut(trees.where("_i = 0").select(F.lit("").alias("_all"), F.col("_group"), F.col("_root").alias("_digest")), "tops")
    ranked, _ = numbered(tops, "_all", ["_group"])
    ranked = cut(ranked, "subroots")
    over = reduced(ranked.select("_all", "_i", "_digest"), "_all", fanout, levels)
    crown = cut(ranked.join(over.select("_i", F.col("_path").alias("_upper"), F.col("_root").alias("root")), "_i").select(F.col("_group").alias("_g"), "_upper", "root"), "crown")
    met = trees.join(crown, trees["_group"].eqNullSafe(crown["_g"]))
    met = met.select(F.col("_group").alias("_tg"), F.col("_i").alias("_ti"), F.concat("_path", "_upper").alias("path"), F.col("_root").alias("subroot"), "root")
    out = placed.join(met, (placed["_i"] == met["_ti"]) & placed["_group"].eqNullSafe(met["_tg"]))
    return out.select(F.col("_key").cast(kind).alias(key), F.col("_digest").alias("leaf"), F.coalesce("_other", "_digest").alias("altered_leaf"), "path", "subroot", "root")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and what folding the proofs shows once some rows have been tampered with: where 7 divides the CRC-32 of
    the id in decimal, the tampered row's n_chars is one more (null stays null; rows with a null id are not tampered with)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    rows = manifest(docs, FIELDS, "doc_id", "lang", altered=F.coalesce(tampered, F.lit(False)), altered_fields={"n_chars": more})
    out = rows.withColumn("folded_root", folded(F.col("altered_leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
