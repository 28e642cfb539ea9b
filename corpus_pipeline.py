"""The corpus pipeline: filters, near-duplicate removal, decontamination and segmentation."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.llm import shingle_join, suffix_decontam, toxicity_gbt, unigram_pieces, zstd_quality
from echogrid.llm.common import table
from echogrid.shared import materialize


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (operator 8); it learns from the given documents that are labelled."""
    return toxicity_gbt.keep_clean(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go (operator 5)."""
    return zstd_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest id (operator 3's links and five-word shingles with a Jaccard similarity of 0.8 or more)."""
    return shingle_join.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go (operator 10)."""
    return suffix_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids and what they decode to, as digests (operator 9)."""
    return unigram_pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", not_toxic), ("quality", good), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("unigram", segmented)]
#: No SQL expresses the trained models; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
