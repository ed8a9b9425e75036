"""From raw documents to packed training sequences: quality filter, near-duplicate removal, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
`documents`. Empty tables pass through; rows with null texts are judged as empty ones and stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.ngramjoin import jaccard_components
from tidemark.llm.packing import pack
from tidemark.llm.pii import redact
from tidemark.llm.quality import keep_good, train
from tidemark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labels, rejects go. Without labels of both classes none does; null texts are
    judged as empty ones."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")), COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays; of rows equal in id and text, one. Documents without words stay."""
    found = cut(jaccard_components(docs).select("doc_id", "n_shingles", "component_id"), "found")
    gone = cut(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    again = cut(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    once = kept.join(again, "doc_id", "left_anti")
    return once.unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind. Every row stays: null and empty texts as they are, repeated rows and rows with
    null ids each for themselves."""
    return redact(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, one row per piece. Every row is packed, also one with a null id, a repeated one, or one whose
    text is null or empty: it has the end token at least."""
    return pack(docs, vocabulary())


STAGES = [("quality_classifier", quality_stage), ("ngram_join", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Learned rules, signatures and token packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
