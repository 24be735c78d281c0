"""The queries that the entry module registers, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.common import read_table
from foliospark.llm.decontaminate import leaks
from foliospark.llm.licenses import license_scan
from foliospark.llm.lm_scores import word_cross_entropy_difference
from foliospark.llm.media import features, store
from foliospark.llm.ngram_join import jaccard_components
from foliospark.llm.packing import pack
from foliospark.llm.quality_rules import quality_scores, train
from foliospark.llm.suffix_dedup import dedup_report, removed_spans
from foliospark.llm.token_counts import token_counts
from foliospark.llm.token_shards import shard_index


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), "word_bpe_49k.json", limit=2048)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(read_table(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read_table(spark, sf_dir, "documents"), n=5, percent=75)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), similarity=0.75, recall=0.99)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"), coverage=0.75)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents that are labelled good, the background all documents."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return word_cross_entropy_difference(spark, read_table(spark, sf_dir, "documents"), good)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, read_table(spark, sf_dir, "labels")), threshold=0.3)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_index(spark, read_table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(removed_spans(spark, read_table(spark, sf_dir, "documents"), length=200))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0, capacity=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_media_columns, op3_ngram_jaccard_join, op4_decontaminate, op5_license_scan, op6_lm_scores, op7_quality_classifier, op8_token_shards, op9_suffix_dedup, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {}
