"""The contract's queries opN_<name>: each applies its operator to its whole table. Modules load when a query runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op3_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngramjoin import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import document_shards

    return document_shards(table(spark, sf_dir, "documents"))


def op10_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mpeg import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.merkle import verified_manifest

    return verified_manifest(table(spark, sf_dir, "documents"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, written as windows and read back."""
    import public_tokenizers

    from tidemark.llm.chat import chat_windows, read_digests
    from tidemark.llm.common import cut, pick

    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    odd = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    windows = cut(chat_windows(turns.unionByName(odd), public_tokenizers.path("byte_bpe_50k.json")), "windows")
    return read_digests(windows)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_license_scan, op2_bootstrapped_pii, op3_projection_passes, op4_packing, op5_ngram_join, op6_rule_ensemble, op7_warc_salvage, op8_prefix_bpe, op9_extendible_shards, op10_mpeg_media, op11_token_alignment, op12_merkle_manifest, op13_chat_windows)}

ORACLE_SQL: dict[str, str] = {
    "op3_projection_passes": oracles.VECTORS,
    "op5_ngram_join": oracles.NGRAM_JOIN,
    "op7_warc_salvage": oracles.WARC,
    "op9_extendible_shards": oracles.SHARDING,
    "op12_merkle_manifest": oracles.MERKLE,
}
