"""Browse queries over entries: filters, orders and pages.

Entries have the columns of ``sources.site.ENTRY`` and ``pos``, their place in
the stored order, which breaks all ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import plain, text, trim

TABS = {"poems": "poem", "blogs": "blog", "quotes": "quote"}


def visible(entries: DataFrame, is_admin: bool = False) -> DataFrame:
    """Drafts are for the admin only."""
    return entries if is_admin else entries.where(~F.coalesce("draft", F.lit(False)))


def holds(array: str, value: str) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def matches(query: str, plain_body: bool = False) -> Column:
    """Whether title, body and tags, as one lower-cased text, hold the query; blank matches all."""
    body = plain("body") if plain_body else text("body")
    whole = F.lower(F.concat_ws(" ", text("title"), body, F.coalesce(F.array_join("tags", " "), F.lit(""))))
    q = F.lower(trim(F.lit(query)))
    return (q == "") | F.contains(whole, q)


def select(entries: DataFrame, is_admin: bool = False, type: str | None = None, lang: str | None = None, collection: str | None = None, tag: str | None = None, query: str | None = None, plain_body: bool = False, drafts_only: bool = False) -> DataFrame:
    """The conjunction of the given filters; equalities come before the text search."""
    out = visible(entries, is_admin)
    if type:
        out = out.where(F.col("type") == TABS.get(type, type))
    if lang and lang != "all":
        out = out.where(F.col("lang") == lang)
    if collection:
        out = out.where(holds("collections", collection))
    if tag:
        out = out.where(holds("tags", tag))
    if drafts_only:
        out = out.where("draft")
    if query:
        out = out.where(matches(query, plain_body))
    return out


def order_keys(sort_by: str | None = None, home_sort: str | None = None) -> list[Column]:
    """manual: stored order, pins ignored; else pinned first, by title, ascending or descending date."""
    by = sort_by or home_sort or "date-desc"
    if by == "manual":
        return [F.col("pos").asc()]
    key = {"title": F.collate(text("title"), "UNICODE").asc(), "date-asc": text("date").asc()}.get(by, text("date").desc())
    return [F.coalesce("pinned", F.lit(False)).desc(), key, F.col("pos").asc()]


def page(entries: DataFrame, shown: int = 1, per_page: int | None = 9, sort_by: str | None = None) -> DataFrame:
    """The first ``shown`` pages, a top-k rather than a full sort."""
    return entries.orderBy(*order_keys(sort_by)).limit(shown * max(1, per_page or 9))


def page_status(entries: DataFrame, shown: int = 1, per_page: int | None = 9) -> DataFrame:
    """One row: total, shown and remaining of a page."""
    size = shown * max(1, per_page or 9)
    return entries.agg(F.count(F.lit(1)).alias("total")).select("total", F.least("total", F.lit(size)).cast("long").alias("shown"), F.greatest(F.lit(0), F.col("total") - size).cast("long").alias("remaining"))


def by_id(rows: DataFrame, wanted: str) -> DataFrame:
    """The first row with the id, drafts included; ``rows`` needs a ``pos``."""
    return rows.where(F.col("id") == wanted).orderBy("pos").limit(1)


def featured(entries: DataFrame, wanted: str, is_admin: bool = False) -> DataFrame:
    return visible(by_id(entries, wanted), is_admin)


def still_there(selected: DataFrame, entries: DataFrame) -> DataFrame:
    """Selected ids that still are entries."""
    return selected.join(entries.select("id"), "id", "left_semi")


def collections_in_order(collections: DataFrame) -> DataFrame:
    return collections.orderBy(F.coalesce("order", F.lit(0.0)), "pos")


def toggled_tag(current: str | None, clicked: str) -> str | None:
    """The same tag again clears the filter."""
    return None if current == clicked else clicked


def toggled(current: Column, clicked: Column) -> Column:
    """As ``toggled_tag``, of columns."""
    return F.when(~current.eqNullSafe(clicked), clicked)


def tag_suggestions(histogram: DataFrame, entry_tags: DataFrame, typed: str, most: int = 10) -> DataFrame:
    """The most popular tags that start with what is typed and that the entry lacks; entry_tags: tag."""
    starts = F.startswith(F.lower("tag"), F.lower(trim(F.lit(typed))))
    return histogram.where(starts).join(entry_tags.select("tag"), "tag", "left_anti").orderBy(F.col("n").desc(), "first_pos", "tag").limit(most)
