"""A corpus preparation pipeline over ``documents``, one stage after the other.

quality classifier -> n-gram Jaccard join -> suffix-array dedup -> benchmark
decontamination -> packing. Each stage takes (spark, docs, sf_dir) and works on
all that its predecessor kept; all but the last return the columns of documents.

In every stage: a null text is an empty one; rows are told apart by a hash of id
and text, so null ids and ids of several texts are rows like others, and rows that
are the same in both are decided on alike; columns other than those of documents
are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import materialize, read_table
from foliospark.llm.decontaminate import leaks
from foliospark.llm.ngram_join import jaccard_rows, row_key
from foliospark.llm.packing import pack
from foliospark.llm.quality_rules import quality_scores, train
from foliospark.llm.suffix_dedup import dedup_texts, removed_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, by which the stages name rows: ids may be null, or stand for several texts."""
    return docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("row_key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier predicts to be of low quality; a document without an id stays out of its training only."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    rows = keyed(docs)
    rejected = quality_scores(rows, model, id_col="row_key").where("predicted = 0").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(rejected, "row_key", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the row with the least id (a null last); rows without words are duplicates only if the same in id and text."""
    found = jaccard_rows(spark, docs, n=5, percent=75)
    # a component of its own for each row without words
    group = F.struct(F.col("component").isNull().alias("alone"), F.coalesce("component", "row_key").alias("key"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    first = found.groupBy(group.alias("group")).agg(F.min(order).alias("first")).select(F.col("first.row_key").alias("row_key"))
    return keyed(docs).join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of the texts all strings of 200 bytes that occur more than once; documents stay, though they become empty."""
    kept = dedup_texts(removed_spans(spark, docs, length=200, carry=("lang", "source")))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage close to a benchmark item."""
    rows = keyed(docs)
    found = leaks(spark, rows, read_table(spark, sf_dir, "benchmark"), id_col="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(materialize(spark, found, "leaks"), "row_key", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the tokenized documents with their places in sequences of 1024."""
    return pack(spark, docs, "byte_bpe_50k.json", end_id=0, capacity=1024)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", long_repeats),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: No SQL: tokenizers and learned rules are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
