"""Queries and SQL of the operators of this subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, host_rules, labelled, licenses, merkle, mixing, neardup, quality, ranking, sharding, sql, tokenfiles, toxicity, turn_trie, url_rules

SHARDS = 16
VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
TOXIC_FROM, GOOD_FROM, COPIES_FROM = 0.5, 0.3, 0.85


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.hilbert_shards(table(spark, sf_dir, "documents"), SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text")
    judged = host_rules.judge(docs).withColumn("host_rate", F.round("host_rate", 6))
    limits = (F.round(f"limit_{r}", 6).alias(f"limit_{r}") for r in host_rules.RULES)
    return judged.select("doc_id", *host_rules.MEASURES, "base_failed", "kept", "host", "host_rate", *limits)


def op3_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "mined")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.with_toxicity(docs, model, keep_text=False), TOXIC_FROM)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.with_quality(docs, model, keep_text=False), GOOD_FROM)


def _scored(scored: DataFrame, limit: float) -> DataFrame:
    held_out = F.coalesce(labelled.fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary, pattern)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), threshold=COPIES_FROM)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "shard_blocks")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return tokenfiles.read_tokens(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie_nodes(turn_trie.branched_paths(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_hilbert_sharding, op2_host_quality_rules, op3_url_association_rules, op4_license_scan, op5_toxicity,
        op6_quality_classifier, op7_byte_bpe, op8_minhash_near_dedup, op9_source_mixing, op10_document_fingerprints, op11_ranked_search, op12_token_files,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """For the others SQL lacks a space-filling curve, FP-growth, MinHash windows, fitted models or a tokenizer."""
    return {"op2_host_quality_rules": sql.HOST_RULES, "op8_minhash_near_dedup": sql.NEAR, "op9_source_mixing": sql.MIX, "op10_document_fingerprints": sql.FINGERPRINTS, "op11_ranked_search": sql.RANKED, "op13_conversation_trie": sql.TRIE}
