"""The operators over their whole tables, as the driver calls them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from echogrid.llm import chat_pairs, imatch, license_scan, merkle_manifest, piece_counts, plane_store, set_relations, simhash, source_divergence, suffix_decontam, toxicity_gbt, unigram_pieces, zstd_quality
from echogrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs.flat(chat_pairs.format_pairs(chat_pairs.neighbours(table(spark, sf_dir, "conversations"))))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.flat(license_scan.scan(table(spark, sf_dir, "documents")))


def op5_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op7_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gbt.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.digest(suffix_decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_relations.jaccard_groups(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


_ALL = (op1_chat_pairs, op2_token_planes, op3_simhash, op4_license_scan, op5_zstd_quality, op6_imatch, op7_piece_counts, op8_toxicity, op9_unigram, op10_decontaminate, op11_set_relations, op12_source_divergence, op13_merkle_manifest)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
#: No SQL for 2, 3, 5, 6, 7, 8 and 9: their tests compare with brute force, round trips or held-out labels.
SQL: dict[str, str] = {"op1_chat_pairs": chat_pairs.SQL, "op4_license_scan": license_scan.sql(), "op10_decontaminate": suffix_decontam.SQL, "op11_set_relations": set_relations.SQL, "op12_source_divergence": source_divergence.SQL, "op13_merkle_manifest": merkle_manifest.SQL}
