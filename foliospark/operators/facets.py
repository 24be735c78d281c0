"""Counts over entries and the lookups between entries and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import label
from foliospark.operators.select import order_keys, visible

TYPES = (("poems", "poem"), ("blogs", "blog"), ("quotes", "quote"))


def _count(when: Column) -> Column:
    return F.count_if(when).cast("long")


def facet_counts(entries: DataFrame, collections: DataFrame, langs: tuple[str, ...] = ("gu", "hi", "en"), is_admin: bool = False) -> DataFrame:
    """One row: visible entries, of each type and language, and all collections."""
    counted = visible(entries, is_admin).agg(F.count(F.lit(1)).alias("all"), *(_count(F.col("type") == t).alias(name) for name, t in TYPES), *(_count(F.col("lang") == x).alias(x) for x in langs))
    return counted.join(collections.agg(F.count(F.lit(1)).alias("collections")))  # one row each


def tag_histogram(entries: DataFrame, is_admin: bool = False) -> DataFrame:
    """tag, n, first_pos: occurrences of each tag, and where it is first met (the order among equals)."""
    return visible(entries, is_admin).select("pos", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def collection_sizes(entries: DataFrame, collections: DataFrame, is_admin: bool = False, all_entries: bool = False) -> DataFrame:
    """id, name, n of every collection, empty ones too; an entry counts once however often it names one."""
    members = (entries if all_entries else visible(entries, is_admin)).select("pos", F.explode(F.array_distinct("collections")).alias("id"))
    sizes = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return collections.join(sizes, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def collection_members(entries: DataFrame, collections: DataFrame, is_admin: bool = False) -> DataFrame:
    """Pairs of a collection and a visible entry of it."""
    members = visible(entries, is_admin).select("pos", F.col("id").alias("entry_id"), F.explode(F.array_distinct("collections")).alias("id"))
    return members.join(collections.select("id", "name"), "id").select("id", "name", "entry_id", "pos")


def entry_collection_names(entries: DataFrame, collections: DataFrame) -> DataFrame:
    """entry_id, names: the names of an entry's collections, in its own order, unknown ids left out."""
    named = entries.select("pos", F.col("id").alias("entry_id"), F.posexplode("collections").alias("at", "id")).join(collections.select("id", "name"), "id")
    lists = named.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("x"))
    return entries.select(F.col("id").alias("entry_id")).join(lists, "entry_id", "left").select("entry_id", F.coalesce(F.col("x.name"), F.array().cast("array<string>")).alias("names"))


def publish_summary(entries: DataFrame) -> DataFrame:
    """One row: counts by type over all entries, drafts too, and the message made of them."""
    c = entries.agg(F.count(F.lit(1)).alias("pieces"), *(_count(F.col("type") == t).alias(name) for name, t in TYPES))
    message = F.format_string("Update writings — %d pieces (%d poems, %d blogs, %d quotes)", "pieces", "poems", "blogs", "quotes")
    return c.withColumn("message", message)


def import_count(files: DataFrame) -> DataFrame:
    return files.agg(_count(F.coalesce(F.col("body"), F.lit("")) != "").alias("added"))


def cards(entries: DataFrame, collections: DataFrame) -> DataFrame:
    """What a list row shows: upper-case language, the first three tags, collection names."""
    names = entry_collection_names(entries, collections)
    return entries.select(F.col("id").alias("entry_id"), "title", F.upper("lang").alias("lang"), F.slice("tags", 1, 3).alias("tags")).join(names, "entry_id")


def collection_pieces(entries: DataFrame, collections: DataFrame, most: int = 12) -> DataFrame:
    """id, pieces, more: the labels of each collection's first pieces, drafts too, and '+ N more' where there are others."""
    members = entries.select("pos", F.col("title"), "type", "body", F.explode(F.array_distinct("collections")).alias("id"))
    sizes = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ranked = members.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("_r") <= most)
    first = ranked.select("id", "_r", label("title", "type", "body").alias("label")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_r", "label"))).alias("x"))
    more = F.when(F.col("n") > most, F.concat(F.lit("+ "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return collections.select("id").join(first.join(sizes, "id"), "id", "left").select("id", F.coalesce(F.col("x.label"), F.array().cast("array<string>")).alias("pieces"), F.coalesce(more, F.lit("")).alias("more"))


def feedback_options(entries: DataFrame, most: int = 200) -> DataFrame:
    """pos, label: what a reader may write about, the first visible entries in the default order."""
    return visible(entries).orderBy(*order_keys()).limit(most).select("pos", label("title", "type", "body").alias("label"))
