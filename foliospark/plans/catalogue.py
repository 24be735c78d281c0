"""The catalogue view over ``documents`` and ``labels``, and the queries over it with their SQL.

The view stands for a site's entries: ``pos`` is the document's id. Each query
is a thin call of an operator; the SQL states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import colour as C
from foliospark.functions import i18n
from foliospark.functions import text as X
from foliospark.operators import changes, facets, merge, select
from foliospark.sources import site

NOW = "2025-06-01T00:00:00.000Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an entry that documents alone tell; texts are not shuffled to join labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lines = F.size(F.split("text", "\n"))
    i = F.col("doc_id")
    kinds = F.when(lines == 1, "quote").when(lines > 14, "blog").otherwise("poem")
    ids = F.array(F.concat(F.lit("c_"), (i % 7).cast("string")))
    ids = F.when(i % 3 == 0, F.array_append(ids, F.concat(F.lit("c_"), ((i + 1) % 7).cast("string")))).otherwise(ids)
    return docs.select(
        i.alias("pos"), F.concat(F.lit("e_"), i.cast("string")).alias("id"), kinds.alias("type"), "lang", F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 60).alias("title"),
        F.col("text").alias("body"), ids.alias("collections"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")), "yyyy-MM-dd").alias("date"),
        (i % 50 == 0).alias("pinned"), "source",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    tags = F.array_compact(F.array("source", F.concat(F.lit("q"), F.col("quality").cast("string")), F.when(F.col("toxic") == 1, "toxic")))
    rows = written(spark, sf_dir).join(labels, F.col("pos") == F.col("doc_id"), "left")
    return rows.select("pos", "id", "type", "lang", "title", "body", tags.alias("tags"), "collections", "date", "pinned", (F.coalesce("toxic", F.lit(0)) == 1).alias("draft"))


#: The same view in SQL; every query's SQL begins with it.
ENTRIES_SQL = """
WITH entries AS (
  SELECT source, d.doc_id AS pos, 'e_' || d.doc_id AS id,
    CASE WHEN len(string_split(text, chr(10))) = 1 THEN 'quote' WHEN len(string_split(text, chr(10))) > 14 THEN 'blog' ELSE 'poem' END AS type,
    lang, substr(string_split(text, chr(10))[1], 1, 60) AS title, text AS body,
    list_filter([source, 'q' || quality, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags,
    CASE WHEN d.doc_id % 3 = 0 THEN ['c_' || (d.doc_id % 7), 'c_' || ((d.doc_id + 1) % 7)] ELSE ['c_' || (d.doc_id % 7)] END AS collections,
    strftime(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') AS date,
    d.doc_id % 50 = 0 AS pinned, coalesce(toxic, 0) = 1 AS draft
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
collections AS (SELECT * FROM (VALUES ('c_0', 'Room 0', 6.0, 0), ('c_1', 'Room 1', 5.0, 1), ('c_2', 'Room 2', 4.0, 2), ('c_3', 'Room 3', 3.0, 3), ('c_4', 'Room 4', 2.0, 4), ('c_5', 'Room 5', 1.0, 5), ('c_6', 'Room 6', 0.0, 6), ('c_empty', 'Empty', 7.0, 7)) t(id, name, "order", pos)),
shown AS (SELECT * FROM entries WHERE NOT draft)
"""
#: White space as in ``functions.text.WS``, for RE2.
WS_SQL = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def collections(spark: SparkSession) -> DataFrame:
    rows = [(f"c_{k}", f"Room {k}", float(6 - k), k) for k in range(7)] + [("c_empty", "Empty", 7.0, 7)]
    return spark.createDataFrame(rows, "id string, name string, order double, pos long")


BRIEF = ("pos", "id", "type", "lang", "title", "date", "pinned")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, plain_sql: bool = False) -> Callable[[Query], Query]:
    """Registers a query; the SQL follows the view unless ``plain_sql``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if plain_sql else ENTRIES_SQL + sql
        return f

    return add


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def plain_of(c: str) -> str:
    """SQL of ``functions.text.plain``."""
    for token, o, x, _ in X.MARKERS:
        quoted = token.replace("*", r"\*")
        c = f"replace(regexp_replace({c}, '{quoted}([^\\n]*?){quoted}', '{o}\\1{x}', 'g'), '{o}{x}', '{token}{token}')"
    return f"regexp_replace({c}, '[{''.join(o + x for _, o, x, _ in X.MARKERS)}]', '', 'g')"


ALL_TEXT = "lower(title || ' ' || body || ' ' || array_to_string(tags, ' '))"


# ------------------------------------------------------------------ browsing
@query(f"SELECT {', '.join(BRIEF)} FROM shown WHERE lang = 'en' AND contains({ALL_TEXT}, 'then') ORDER BY pinned DESC, date DESC, pos LIMIT 9")
def select_page(spark, d):
    return select.page(select.select(entries(spark, d), lang="en", query=" Then "), 1, 9).select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown WHERE type = 'blog' ORDER BY pinned DESC, date DESC, pos LIMIT 18")
def select_by_type(spark, d):
    return select.page(select.select(entries(spark, d), type="blogs"), 2, 9).select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown WHERE lang = 'fr'")
def select_by_lang(spark, d):
    return select.select(entries(spark, d), lang="fr").select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown WHERE list_contains(tags, 'q1')")
def select_by_tag(spark, d):
    return select.select(entries(spark, d), tag="q1").select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown WHERE list_contains(collections, 'c_3')")
def select_by_collection(spark, d):
    return select.select(entries(spark, d), collection="c_3").select(*BRIEF)


@query(f"SELECT pos, id FROM shown WHERE contains({ALL_TEXT}, 'src1 q1')")
def search_raw(spark, d):
    return select.select(entries(spark, d), query="Src1 Q1").select("pos", "id")


@query(f"SELECT pos, id FROM shown WHERE contains(lower(title || ' ' || {plain_of('body')} || ' ' || array_to_string(tags, ' ')), 'license')")
def search_plain(spark, d):
    return select.select(entries(spark, d), query="license", plain_body=True).select("pos", "id")


@query(f"SELECT {', '.join(BRIEF)} FROM entries WHERE draft")
def drafts_only(spark, d):
    return select.select(entries(spark, d), is_admin=True, drafts_only=True).select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown ORDER BY pinned DESC, date, pos LIMIT 50")
def order_date_asc(spark, d):
    return select.page(select.visible(entries(spark, d)), 1, 50, "date-asc").select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown ORDER BY pos LIMIT 50")
def order_manual(spark, d):
    return select.page(select.visible(entries(spark, d)), 1, 50, "manual").select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown ORDER BY pinned DESC, title COLLATE en, pos LIMIT 50")
def order_title(spark, d):
    return select.page(select.visible(entries(spark, d)), 1, 50, "title").select(*BRIEF)


@query("SELECT count(*) AS total, least(count(*), 18) AS shown, greatest(0, count(*) - 18) AS remaining FROM shown")
def page_status(spark, d):
    return select.page_status(select.visible(entries(spark, d)), 2, 9)


@query(f"SELECT {', '.join(BRIEF)} FROM entries WHERE id = 'e_28'")
def entry_by_id(spark, d):
    return select.by_id(entries(spark, d), "e_28").select(*BRIEF)


@query(f"SELECT {', '.join(BRIEF)} FROM shown WHERE id = 'e_50'")
def featured_entry(spark, d):
    return select.featured(entries(spark, d), "e_50").select(*BRIEF)


@query("SELECT DISTINCT 'e_' || doc_id AS id FROM labels WHERE 'e_' || doc_id IN (SELECT id FROM entries)")
def selected_still_there(spark, d):
    chosen = table(spark, d, "labels").select(F.concat(F.lit("e_"), F.col("doc_id").cast("string")).alias("id"))
    return select.still_there(chosen, entries(spark, d)).distinct()


@query("SELECT id, name, \"order\" FROM collections ORDER BY coalesce(\"order\", 0), pos")
def collection_order(spark, d):
    return select.collections_in_order(collections(spark)).select("id", "name", "order")


# ------------------------------------------------------------- counts, lookups
@query("""SELECT count(*) AS "all", count(*) FILTER (type = 'poem') AS poems, count(*) FILTER (type = 'blog') AS blogs, count(*) FILTER (type = 'quote') AS quotes,
  count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es, (SELECT count(*) FROM collections) AS collections FROM shown""")
def facet_counts(spark, d):
    return facets.facet_counts(entries(spark, d), collections(spark), ("en", "fr", "de", "es"))


@query("SELECT tag, count(*) AS n, min(pos) AS first_pos FROM (SELECT pos, unnest(tags) AS tag FROM shown) GROUP BY tag")
def tag_histogram(spark, d):
    return facets.tag_histogram(entries(spark, d))


@query("SELECT tag, n, first_pos FROM (SELECT tag, count(*) AS n, min(pos) AS first_pos FROM (SELECT pos, unnest(tags) AS tag FROM shown) GROUP BY tag) WHERE starts_with(lower(tag), 'src1') AND tag NOT IN (SELECT unnest(tags) FROM entries WHERE id = 'e_11') ORDER BY n DESC, first_pos, tag LIMIT 10")
def tag_suggest(spark, d):
    e = entries(spark, d)
    own = e.where("id = 'e_11'").select(F.explode("tags").alias("tag"))
    return select.tag_suggestions(facets.tag_histogram(e), own, " Src1").select("tag", "n", "first_pos")


@query("SELECT c.id, c.name, count(m.pos) AS n FROM collections c LEFT JOIN (SELECT DISTINCT pos, unnest(collections) AS id FROM shown) m ON c.id = m.id GROUP BY ALL")
def collection_sizes(spark, d):
    return facets.collection_sizes(entries(spark, d), collections(spark))


@query("SELECT c.id, c.name, count(m.pos) AS n FROM collections c LEFT JOIN (SELECT DISTINCT pos, unnest(collections) AS id FROM entries) m ON c.id = m.id GROUP BY ALL")
def collection_sizes_all(spark, d):
    return facets.collection_sizes(entries(spark, d), collections(spark), all_entries=True)


@query("SELECT c.id, c.name, m.entry_id, m.pos FROM (SELECT DISTINCT pos, id AS entry_id, unnest(collections) AS id FROM shown) m JOIN collections c ON c.id = m.id")
def collection_members(spark, d):
    return facets.collection_members(entries(spark, d), collections(spark))


@query("SELECT e.id AS entry_id, string_agg(c.name, ', ' ORDER BY e.i) AS names FROM (SELECT id, unnest(collections) AS c, generate_subscripts(collections, 1) AS i FROM entries) e JOIN collections c ON c.id = e.c GROUP BY e.id")
def entry_collection_names(spark, d):
    return facets.entry_collection_names(written(spark, d), collections(spark)).select("entry_id", F.array_join("names", ", ").alias("names"))


@query("""SELECT count(*) AS pieces, count(*) FILTER (type = 'poem') AS poems, count(*) FILTER (type = 'blog') AS blogs, count(*) FILTER (type = 'quote') AS quotes,
  'Update writings — ' || count(*) || ' pieces (' || count(*) FILTER (type = 'poem') || ' poems, ' || count(*) FILTER (type = 'blog') || ' blogs, ' || count(*) FILTER (type = 'quote') || ' quotes)' AS message FROM entries""")
def publish_summary(spark, d):
    return facets.publish_summary(entries(spark, d))


@query("""SELECT e.id AS entry_id, title, upper(lang) AS lang, array_to_string(tags[1:3], ', ') AS tags, n.names FROM entries e
  LEFT JOIN (SELECT x.id, string_agg(c.name, ', ' ORDER BY x.i) AS names FROM (SELECT id, unnest(collections) AS c, generate_subscripts(collections, 1) AS i FROM entries) x JOIN collections c ON c.id = x.c GROUP BY x.id) n ON n.id = e.id""")
def cards(spark, d):
    found = facets.cards(entries(spark, d), collections(spark))
    return found.select("entry_id", "title", "lang", F.array_join("tags", ", ").alias("tags"), F.array_join("names", ", ").alias("names"))


# -------------------------------------------------------------------- texts
@query(f"""SELECT pos, CASE WHEN type = 'blog' THEN CASE WHEN length(flat) > 240 THEN {trimmed('substr(flat, 1, 240)')} || '…' ELSE flat END
  ELSE array_to_string(string_split(t, chr(10))[1:6], chr(10)) || CASE WHEN len(string_split(t, chr(10))) > 6 THEN chr(10) || '…' ELSE '' END END AS preview
  FROM (SELECT pos, type, t, regexp_replace({plain_of('t')}, '{WS_SQL}+', ' ', 'g') AS flat FROM (SELECT pos, type, {trimmed('body')} AS t FROM entries))""")
def preview(spark, d):
    return written(spark, d).select("pos", X.preview("type", "body", F.lit("")).alias("preview"))


@query(f"""SELECT pos, words, greatest(1, CAST(floor(words / 180.0 + 0.5) AS BIGINT)) AS minutes FROM (SELECT pos, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '{WS_SQL}+')) END AS words FROM (SELECT pos, {trimmed('body')} AS t FROM entries))""")
def reading_stats(spark, d):
    return written(spark, d).select("pos", X.words("body").alias("words")).withColumn("minutes", X.minutes(F.col("words")))


@query(f"SELECT pos, CAST(len(list_filter(string_split(body, chr(10)), lambda x: {trimmed('x')} <> '')) AS BIGINT) AS lines FROM entries")
def line_count(spark, d):
    return written(spark, d).select("pos", X.line_count("body").alias("lines"))


@query(f"SELECT pos, {plain_of('body')} AS plain FROM entries")
def plain_text(spark, d):
    return written(spark, d).select("pos", X.plain("body").alias("plain"))


@query(f"SELECT pos, {plain_of('body')} <> body AS has_markup FROM entries")
def has_markup(spark, d):
    return written(spark, d).select("pos", X.has_markup("body").alias("has_markup"))


def marked_up(spark: SparkSession, d: str) -> DataFrame:
    """The texts with markers around words, in one of three ways by pos, beside those that they have."""
    pairs = F.element_at(F.array(F.lit("**$1** __$2__"), F.lit("*$1 $2* **"), F.lit("__$1 **$2**__ *")), (F.col("pos") % 3 + 1).cast("int"))
    return written(spark, d).select("pos", F.regexp_replace("body", F.lit("([a-z]+) ([a-z]+)"), pairs).alias("body"))


def sentinels_of(c: str) -> str:
    """SQL of ``functions.text.marked``."""
    return plain_of(c).removeprefix("regexp_replace(").rsplit(", '[", 1)[0]


_ENDS = "".join(o + x for _, o, x, _ in X.MARKERS)
_FLAGS = ", ".join(f"sum(CASE WHEN t IN ('{o}', '{x}') THEN 1 ELSE 0 END) OVER (PARTITION BY pos ORDER BY i) % 2 = 1 AS {f}_" for _, o, x, f in X.MARKERS)
MARKED_SQL = f""",
marked AS (SELECT pos, regexp_replace(body, '([a-z]+) ([a-z]+)', ['**\\1** __\\2__', '*\\1 \\2* **', '__\\1 **\\2**__ *'][pos % 3 + 1], 'g') AS body FROM entries),
parts AS (SELECT pos, regexp_extract_all({sentinels_of('body')}, '[{_ENDS}]|\n|[^{_ENDS}\n]+') AS p FROM marked),
runs AS (SELECT * FROM (SELECT pos, i, t, {_FLAGS} FROM (SELECT pos, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM parts)) WHERE NOT regexp_matches(t, '[{_ENDS}]'))
"""
FLAGS_SQL = "CASE WHEN b_ THEN 'b' ELSE '-' END || CASE WHEN i_ THEN 'i' ELSE '-' END || CASE WHEN u_ THEN 'u' ELSE '-' END"


def flagged(r: Column) -> Column:
    """A run's formatting and text as one text."""
    return F.concat(*(F.when(r[f], f).otherwise("-") for f in "biu"), r["t"])


@query(MARKED_SQL + f"SELECT m.pos, coalesce(string_agg({FLAGS_SQL} || t, chr(31) ORDER BY r.i), '') AS runs FROM marked m LEFT JOIN runs r ON m.pos = r.pos GROUP BY m.pos")
def markup_runs(spark, d):
    return marked_up(spark, d).select("pos", F.array_join(F.transform(X.runs("body"), flagged), "\x1f").alias("runs"))


@query(MARKED_SQL + f"SELECT m.pos, coalesce(string_agg({FLAGS_SQL} || w, chr(31) ORDER BY r.i, r.k), '') AS tokens FROM marked m LEFT JOIN (SELECT *, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT *, regexp_extract_all(t, '{WS_SQL}+|{WS_SQL.replace('[', '[^', 1)}+') AS ws FROM runs)) r ON m.pos = r.pos GROUP BY m.pos")
def markup_tokens(spark, d):
    return marked_up(spark, d).select("pos", F.array_join(F.transform(X.tokens("body"), flagged), "\x1f").alias("tokens"))


HTML_SQL = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(MARKED_SQL + "SELECT m.pos, coalesce(string_agg(CASE WHEN b_ THEN '<strong>' ELSE '' END || CASE WHEN i_ THEN '<em>' ELSE '' END || CASE WHEN u_ THEN '<u>' ELSE '' END || " + HTML_SQL.format("t") + " || CASE WHEN u_ THEN '</u>' ELSE '' END || CASE WHEN i_ THEN '</em>' ELSE '' END || CASE WHEN b_ THEN '</strong>' ELSE '' END, '' ORDER BY r.i), '') AS html FROM marked m LEFT JOIN runs r ON m.pos = r.pos GROUP BY m.pos")
def markup_html(spark, d):
    return marked_up(spark, d).select("pos", X.html("body").alias("html"))


@query(f"SELECT pos, len(list_filter(string_split(body, chr(10)), lambda x: NOT (length(x) >= 5 AND starts_with(x, '**') AND ends_with(x, '**')))) = 0 AS wrapped, {plain_of('body')} <> body AS any_markup FROM (SELECT pos, CASE WHEN pos % 2 = 0 THEN regexp_replace(body, '([^\n]+)', '**\\1**', 'g') ELSE body END AS body FROM entries)")
def wrapped_lines(spark, d):
    """Every line of half the texts is put between markers."""
    rows = written(spark, d).select("pos", F.when(F.col("pos") % 2 == 0, F.regexp_replace("body", "([^\\n]+)", "**$1**")).otherwise(F.col("body")).alias("body"))
    return rows.select("pos", X.every_wrapped("body", "**").alias("wrapped"), X.has_markup("body").alias("any_markup"))


#: Letters that stand for a to j in other scripts.
GU, HI = "\u0a95\u0a96\u0a97\u0a98\u0a9a\u0a9b\u0a9c\u0a9d\u0a9f\u0aa0", "\u0915\u0916\u0917\u0918\u091a\u091b\u091c\u091d\u091f\u0920"
SCRIPTED_SQL = f"CASE {{0}} % 5 WHEN 1 THEN translate({{1}}, 'abcdefghij', '{GU}') WHEN 2 THEN translate({{1}}, 'abcdefghij', '{HI}') WHEN 3 THEN translate({{1}}, 'zxj', '{GU[:3]}') || '{HI[:4]}' WHEN 4 THEN regexp_replace({{1}}, '[b-zB-Z]', '', 'g') ELSE {{1}} END"
COUNTS_SQL = "len(regexp_extract_all(body, '[\\x{0A80}-\\x{0AFF}]')) AS gu, len(regexp_extract_all(body, '[\\x{0900}-\\x{097F}]')) AS hi, len(regexp_extract_all(body, '[A-Za-z]')) AS latin"
FOUND_SQL = "CASE WHEN gu > hi AND gu > 3 THEN 'gu' WHEN hi > gu AND hi > 3 THEN 'hi' ELSE 'en' END"


def scripted(by: Column, c: Column) -> Column:
    """A text in one of five mixtures of scripts."""
    k = by % 5
    return (
        F.when(k == 1, F.translate(c, "abcdefghij", GU)).when(k == 2, F.translate(c, "abcdefghij", HI))
        .when(k == 3, F.concat(F.translate(c, "zxj", GU[:3]), F.lit(HI[:4]))).when(k == 4, F.regexp_replace(c, "[b-zB-Z]", "")).otherwise(c)
    )


@query(f"SELECT pos, {FOUND_SQL} AS found, gu, hi, latin FROM (SELECT pos, {COUNTS_SQL} FROM (SELECT pos, {SCRIPTED_SQL.format('pos', 'body')} AS body FROM entries))")
def detect_lang(spark, d):
    rows = written(spark, d).select("pos", scripted(F.col("pos"), F.col("body")).alias("body"))
    return rows.select("pos", X.detect_lang("body").alias("found"), X.script_counts("body").alias("n")).select("pos", "found", "n.*")


@query(f"SELECT conv_id, turn, CASE WHEN {FOUND_SQL} = 'en' AND latin < 12 THEN 'hi' ELSE {FOUND_SQL} END AS lang FROM (SELECT conv_id, turn, {COUNTS_SQL} FROM (SELECT conv_id, turn, {SCRIPTED_SQL.format('(conv_id + turn)', 'text')} AS body FROM conversations))", plain_sql=True)
def auto_lang(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", scripted(F.col("conv_id") + F.col("turn"), F.col("text")).alias("text"))
    return rows.select("conv_id", "turn", X.auto_lang("text", F.lit("hi")).alias("lang"))


@query(f"""SELECT pos, title, body, {FOUND_SQL} AS lang, CASE WHEN len(string_split(body, chr(10))) > 14 THEN 'blog' ELSE 'poem' END AS type, TRUE AS draft, '2025-06-01' AS date
  FROM (SELECT *, {COUNTS_SQL} FROM (SELECT doc_id AS pos, 'file ' || doc_id AS title, {trimmed(SCRIPTED_SQL.format('doc_id', 'text'))} AS body FROM documents)) WHERE body <> ''""", plain_sql=True)
def import_classify(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("file_-"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("name"), F.replace(scripted(F.col("doc_id"), F.col("text")), F.lit("\n"), F.lit("\r\n")).alias("raw"))
    rows = site.import_drafts(files, "2025-06-01")
    return rows.select(F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("pos"), "title", "body", "lang", "type", "draft", "date")


@query("SELECT count(*) AS added FROM documents WHERE text <> ''", plain_sql=True)
def import_count(spark, d):
    return facets.import_count(table(spark, d, "documents").select(F.col("text").alias("body")))


@query(f"""SELECT pos, CASE WHEN n = '' THEN 'writing' ELSE n END || '-' || date AS filename FROM (SELECT pos, date,
  substr(regexp_replace(regexp_replace(CASE WHEN title = '' THEN upper(type[1]) || type[2:] ELSE title END, '[\\\\/:*?"<>|]+', '', 'g'), '{WS_SQL}+', '-', 'g'), 1, 60) AS n FROM entries)""")
def safe_filename(spark, d):
    return written(spark, d).select("pos", X.safe_filename("title", "type", "date").alias("filename"))


@query(f"SELECT page_id, CASE WHEN NOT regexp_matches(t, '[\"''<>\\\\]|{WS_SQL}') AND (regexp_matches(t, '(?i)^https?://') OR (regexp_matches(t, '^\\.{{0,2}}/') AND NOT starts_with(t, '//'))) THEN t ELSE '' END AS safe, CASE WHEN NOT regexp_matches(t, '[\"''()\\\\]|{WS_SQL}') AND regexp_matches(t, '(?i)^https://.') THEN t ELSE '' END AS safe_image FROM (SELECT page_id, {trimmed('url')} AS t FROM pages)", plain_sql=True)
def safe_urls(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_url("url").alias("safe"), X.safe_image_url("url").alias("safe_image"))


@query("SELECT page_id, " + HTML_SQL.format("html") + " AS escaped, regexp_replace(html, '[\"''\\\\<>();]', '', 'g') AS css FROM pages", plain_sql=True)
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_html("html").alias("escaped"), X.escape_css("html").alias("css"))


@query("SELECT doc_id, to_base64(encode(text)) AS encoded, text AS decoded FROM documents", plain_sql=True)
def base64_roundtrip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.to_base64("text").alias("encoded"))
    return docs.withColumn("decoded", X.from_base64("encoded"))


_KEPT = (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"))
_ENCODED = "url_encode(title || ' a+b!~*''()')"
for _code, _char in _KEPT:
    _ENCODED = f"replace({_ENCODED}, '{_code}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT pos, 'https://example.org/w/#/e/' || id AS url, {_ENCODED} AS encoded FROM entries")
def entry_urls(spark, d):
    return written(spark, d).select("pos", X.entry_url("https://example.org/w/", "id").alias("url"), X.encode_component(F.concat("title", F.lit(" a+b!~*'()"))).alias("encoded"))


@query(f"SELECT pos, '── ' || CASE WHEN title = '' THEN upper(type[1]) || type[2:] ELSE title END || ' ──' || chr(10) || upper(type[1]) || type[2:] || ' · ' || upper(lang) || ' · ' || date || chr(10) || chr(10) || {trimmed('body')} || chr(10) || chr(10) || source AS value FROM shown")
def export_text(spark, d):
    return site.export_text(entries(spark, d).withColumn("credit", F.col("tags")[0]))


@query(f"SELECT id, CASE WHEN title = '' THEN '' ELSE title || chr(10) || chr(10) END || {plain_of(trimmed('body'))} || chr(10) || chr(10) || source || chr(10) || chr(10) || '— A. Writer' || chr(10) || 'https://example.org/w/#/e/' || id AS value FROM entries")
def entry_texts(spark, d):
    return site.entry_texts(written(spark, d).withColumn("credit", F.col("source")), "A. Writer", "https://example.org/w/")


_FLAT = f"regexp_replace({plain_of('t')}, '{WS_SQL}+', ' ', 'g')"
_SHORT = f"CASE WHEN type = 'blog' THEN CASE WHEN length({_FLAT}) > 240 THEN {trimmed(f'substr({_FLAT}, 1, 240)')} || '…' ELSE {_FLAT} END ELSE string_split(t, chr(10))[1] || CASE WHEN len(string_split(t, chr(10))) > 1 THEN chr(10) || '…' ELSE '' END END"


@query(f"SELECT pos, CASE WHEN title <> '' THEN title ELSE substr(regexp_replace({plain_of('short')}, '{WS_SQL}+', ' ', 'g'), 1, 60) END AS label FROM (SELECT pos, title, {_SHORT} AS short FROM (SELECT pos, type, CASE WHEN pos % 2 = 0 THEN title ELSE '' END AS title, {trimmed('body')} AS t FROM entries))")
def entry_label(spark, d):
    """Every other entry has lost its title."""
    return written(spark, d).select("pos", X.label(F.when(F.col("pos") % 2 == 0, F.col("title")).otherwise(""), F.col("type"), F.col("body")).alias("label"))


@query("SELECT pos, CAST(CAST(date[9:10] AS INT) AS VARCHAR) || ' ' || strftime(CAST(date AS DATE), '%B') || ' ' || date[1:4] AS day FROM entries")
def formatted_dates(spark, d):
    return written(spark, d).select("pos", i18n.format_date("date").alias("day"))


@query("SELECT conv_id, turn, 'About: ' || role || chr(10) || 'From: ' || 'R' || conv_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '— sent from Rooms' AS body, 'Feedback on Rooms — ' || role AS subject FROM conversations", plain_sql=True)
def feedback_messages(spark, d):
    fields = F.struct(F.concat(F.lit("R"), F.col("conv_id").cast("string")).alias("name"), F.lit("").alias("email"), F.col("role").alias("about"), F.col("text").alias("message"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.feedback_body(fields, "Rooms").alias("body"), X.feedback_subject(fields, "Rooms").alias("subject"))


# -------------------------------------------------------------------- merging
def copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A local copy, a remote copy and the base both began with, of all entries: by remainders of pos some have other ids, or no id, or no stamp."""
    e = entries(spark, d).select("pos", "id", "type", "title", "body", F.array_join("tags", ",").alias("tags"))
    p = F.col("pos")
    stamp = lambda k: F.format_string("2025-01-%02dT00:00:00.000Z", k)
    own = F.when(p % 5 == 0, F.concat(F.lit("own_"), "id")).otherwise(F.col("id"))
    theirs = F.when(p % 7 == 0, F.concat(F.lit("their_"), "id")).when(p % 41 != 0, F.col("id"))
    local = e.withColumns({"id": own, "updatedAt": F.when(p % 11 != 0, stamp((p % 3 + 1).cast("int")))})
    remote = e.withColumns({"id": theirs, "updatedAt": F.when(p % 13 != 0, stamp((p % 4 + 1).cast("int"))), "title": F.concat(F.lit("remote "), F.col("title"))})
    base = e.select(F.when(p % 2 == 0, theirs).otherwise(F.concat(F.lit("gone_"), "id")).alias("id"), stamp((p % 4 + p % 3).cast("int")).alias("updatedAt")).where("id IS NOT NULL")
    return local, remote, base


COPIES_SQL = """,
own AS (SELECT *, array_to_string(tags, ',') AS tag_text, CASE WHEN pos % 5 = 0 THEN 'own_' || id ELSE id END AS own_id, CASE WHEN pos % 7 = 0 THEN 'their_' || id WHEN pos % 41 <> 0 THEN id END AS their_id FROM entries),
local AS (SELECT pos, own_id AS id, type, title, body, tag_text AS tags, CASE WHEN pos % 11 <> 0 THEN '2025-01-0' || (pos % 3 + 1) || 'T00:00:00.000Z' END AS updatedAt FROM own),
remote AS (SELECT pos, their_id AS id, type, 'remote ' || title AS title, body, tag_text AS tags, CASE WHEN pos % 13 <> 0 THEN '2025-01-0' || (pos % 4 + 1) || 'T00:00:00.000Z' END AS updatedAt FROM own),
base AS (SELECT * FROM (SELECT CASE WHEN pos % 2 = 0 THEN their_id ELSE 'gone_' || id END AS id, '2025-01-0' || (pos % 4 + pos % 3) || 'T00:00:00.000Z' AS updatedAt FROM own) WHERE id IS NOT NULL),
actions AS (SELECT coalesce(l.id, r.id) AS id, l, r,
  CASE WHEN r.id IS NULL THEN 'local_only' WHEN l.id IS NULL AND b.id IS NOT NULL AND NOT coalesce(r.updatedAt, '') > b.updatedAt THEN 'deletedHere' WHEN l.id IS NULL THEN 'kept'
    WHEN coalesce(r.updatedAt, '') > coalesce(l.updatedAt, '') THEN 'updated' ELSE 'local' END AS action
  FROM local l FULL OUTER JOIN (SELECT * FROM remote WHERE id IS NOT NULL) r ON l.id = r.id LEFT JOIN base b ON b.id = coalesce(l.id, r.id))
"""
FOLDED_SQL = COPIES_SQL + """SELECT id, action, CASE WHEN action = 'kept' THEN (SELECT max(pos) FROM local) + 1 + r.pos ELSE l.pos END AS pos, x.type, x.title, x.body, x.tags, x.updatedAt AS "updatedAt"
  FROM (SELECT *, CASE WHEN action IN ('kept', 'updated') THEN r ELSE l END AS x FROM actions) WHERE action <> 'deletedHere'"""


@query(FOLDED_SQL)
def fold_entries(spark, d):
    return merge.fold_entries(*copies(spark, d)).select("id", "action", "pos", "type", "title", "body", "tags", "updatedAt")


@query(FOLDED_SQL.replace("SELECT id, action, ", "SELECT id, "))
def draft_over_served(spark, d):
    local, remote, base = copies(spark, d)
    return site.current_entries(remote, local, base).select("id", "pos", "type", "title", "body", "tags", "updatedAt")


@query(COPIES_SQL + "SELECT count(*) FILTER (action = 'kept') AS kept, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'deletedHere') AS \"deletedHere\" FROM actions")
def fold_report(spark, d):
    return merge.fold_report(merge.fold_actions(*copies(spark, d)))


@query(COPIES_SQL + "SELECT count(*) FILTER (action <> 'deletedHere') AS merged, count(*) FILTER (action = 'deletedHere') AS \"deletedHere\", (SELECT count(*) FROM remote) AS remote_rows, count(*) FILTER (action <> 'deletedHere') >= (SELECT count(*) FROM remote) - count(*) FILTER (action = 'deletedHere') AS safe FROM actions")
def fold_guard(spark, d):
    local, remote, base = copies(spark, d)
    return merge.fold_guard(merge.fold_actions(local, remote, base), remote)


@query("SELECT id, name, pos FROM collections WHERE pos < 4 UNION ALL SELECT id, name, 4 + pos FROM collections WHERE pos >= 4 AND id <> 'c_5'")
def fold_collections(spark, d):
    c = collections(spark)
    return merge.fold_collections(c.where("pos < 4"), c, c.where("id IN ('c_5')")).select("id", "name", "pos")


@query("""SELECT pos, id, title FROM entries UNION ALL
  SELECT (SELECT max(pos) FROM entries) + 1 + pos, CASE WHEN pos % 3 = 0 THEN 'e_' || sha256(id || chr(31) || pos || chr(31) || 'import')[1:12] ELSE 'n' || id END, 'new ' || title FROM entries""")
def import_merge(spark, d):
    """All entries come in again under new titles, two thirds of them with ids of their own."""
    e = written(spark, d).select("pos", "id", "title")
    incoming = e.select("pos", F.when(F.col("pos") % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("n"), "id")).alias("id"), F.concat(F.lit("new "), "title").alias("title"))
    return merge.import_merge(e, incoming)


@query("SELECT side, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['a', 'b']) AS side, pos FROM entries) WHERE pos % 4 = 1 GROUP BY side")
def content_diff(spark, d):
    """All entries against all of them with every fourth title changed."""
    e = entries(spark, d)
    return merge.content_diff(e, e.withColumn("title", F.when(F.col("pos") % 4 == 1, F.concat("title", F.lit("!"))).otherwise(F.col("title"))))


@query("SELECT id, array_to_string(CASE WHEN type = 'quote' AND NOT list_contains(collections, 'c_1') THEN list_append(collections, 'c_1') ELSE collections END, ',') AS collections, CASE WHEN type = 'quote' AND NOT list_contains(collections, 'c_1') THEN '2025-06-01T00:00:00.000Z' ELSE '' END AS updatedAt FROM entries")
def set_membership(spark, d):
    e = written(spark, d).withColumn("updatedAt", F.lit(""))
    return changes.set_membership(e, F.col("type") == "quote", "c_1", True, NOW).select("id", F.array_join("collections", ",").alias("collections"), "updatedAt")


@query("SELECT id, array_to_string(list_filter(collections, lambda x: x <> 'c_2'), ',') AS collections FROM entries")
def cascade_delete(spark, d):
    return merge.cascade_delete(written(spark, d), collections(spark), "c_2")[0].select("id", F.array_join("collections", ",").alias("collections"))


@query("SELECT pos, id, title, '' AS \"updatedAt\" FROM entries UNION ALL SELECT (SELECT min(pos) FROM entries) - row_number() OVER (ORDER BY pos), 'new_' || id, title, '2025-06-01T00:00:00.000Z' FROM entries")
def insert_entries(spark, d):
    """All entries are added once more."""
    e = written(spark, d).select("pos", "id", "title", F.lit("").alias("updatedAt"))
    return changes.insert_entries(e, e.withColumn("id", F.concat(F.lit("new_"), "id")), NOW)


@query("SELECT id, type, title, CASE WHEN lang = 'de' THEN '2025-06-01T00:00:00.000Z' ELSE '' END AS updatedAt, pinned OR lang = 'de' AS pinned FROM entries")
def update_entries(spark, d):
    e = written(spark, d).withColumn("updatedAt", F.lit(""))
    return changes.update_entries(e, F.col("lang") == "de", {"pinned": F.lit(True), "updatedAt": F.lit("old")}, NOW).select("id", "type", "title", "updatedAt", "pinned")


@query("SELECT id, title FROM entries WHERE pos NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_entries(spark, d):
    bad = table(spark, d, "labels").where("quality = 0").select(F.concat(F.lit("e_"), F.col("doc_id").cast("string")).alias("id"))
    return changes.delete_entries(entries(spark, d), bad).select("id", "title")


def shelves(spark: SparkSession, d: str) -> DataFrame:
    """A collection for each nation; some have no order."""
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("n_"), n.cast("string")).alias("id"), F.col("n_name").alias("name"), F.when(n % 4 != 0, (n * 7 % 25).cast("double")).alias("order"), n.cast("long").alias("pos"))


SHELVES_SQL = "WITH shelves AS (SELECT 'n_' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey * 7 % 25 AS DOUBLE) END AS \"order\", CAST(n_nationkey AS BIGINT) AS pos FROM nation), ranked AS (SELECT *, row_number() OVER (ORDER BY coalesce(\"order\", 0), pos) - 1 AS r FROM shelves), spot AS (SELECT r AS k FROM ranked WHERE id = 'n_3') "


@query(SHELVES_SQL + "SELECT 'up' AS way, id, CAST(CASE WHEN r = k AND k > 0 THEN k - 1 WHEN r = k - 1 THEN k ELSE r END AS DOUBLE) AS \"order\" FROM ranked, spot UNION ALL SELECT 'down', id, CAST(CASE WHEN r = k AND k < 24 THEN k + 1 WHEN r = k + 1 THEN k ELSE r END AS DOUBLE) FROM ranked, spot UNION ALL SELECT 'first up', id, CAST(r AS DOUBLE) FROM ranked", plain_sql=True)
def move_collection(spark, d):
    rows = shelves(spark, d)
    moved = [changes.move(rows, who, by).select(F.lit(way).alias("way"), "id", "order") for way, who, by in (("up", "n_3", -1), ("down", "n_3", 1), ("first up", "n_0", -1))]
    return moved[0].unionByName(moved[1]).unionByName(moved[2])


@query(SHELVES_SQL + "SELECT id, name, pos FROM shelves UNION ALL SELECT 'x_' || id, name, 25 + pos FROM shelves", plain_sql=True)
def insert_collections(spark, d):
    rows = shelves(spark, d)
    return changes.insert_collection(rows, rows.withColumn("id", F.concat(F.lit("x_"), "id"))).select("id", "name", "pos")


# ------------------------------------------------------------------- colours
def hexes(spark: SparkSession, d: str) -> DataFrame:
    """A colour, and one to go with it, for each part."""
    p = F.col("p_partkey")
    hexed = lambda c: F.concat(F.lit("#"), F.lpad(F.lower(F.hex(c)), 6, "0"))
    return table(spark, d, "part").select("p_partkey", hexed(p * 7919 % 16777216).alias("a"), hexed(p * 104729 % 16777216).alias("b"))


HEX_SQL = """WITH h AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS x, p_partkey * 104729 % 16777216 AS y FROM part),
c AS (SELECT p_partkey, '#' || lower(printf('%06x', x)) AS a, '#' || lower(printf('%06x', y)) AS b, x // 65536 AS xr, x // 256 % 256 AS xg, x % 256 AS xb, y // 65536 AS yr, y // 256 % 256 AS yg, y % 256 AS yb FROM h)
"""
LIN = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE power(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(HEX_SQL + "SELECT p_partkey, a, round(l, 9) AS luminance, l > 0.45 AS light, 'rgba(' || xr || ',' || xg || ',' || xb || ',0.5)' AS css FROM (SELECT *, 0.2126 * (" + LIN.format("xr") + ") + 0.7152 * (" + LIN.format("xg") + ") + 0.0722 * (" + LIN.format("xb") + ") AS l FROM c)", plain_sql=True)
def colour_luminance(spark, d):
    return hexes(spark, d).select("p_partkey", "a", F.round(C.luminance("a"), 9).alias("luminance"), C.is_light("a").alias("light"), C.rgba("a", 0.5).alias("css"))


@query(HEX_SQL + "SELECT p_partkey, '#' || lower(printf('%02x%02x%02x', CAST(floor(xr + (yr - xr) * 0.25 + 0.5) AS BIGINT), CAST(floor(xg + (yg - xg) * 0.25 + 0.5) AS BIGINT), CAST(floor(xb + (yb - xb) * 0.25 + 0.5) AS BIGINT))) AS mixed FROM c", plain_sql=True)
def colour_mix(spark, d):
    return hexes(spark, d).select("p_partkey", C.mix("a", "b", 0.25).alias("mixed"))


def three_stops() -> Column:
    """Stops at 0, the key's remainder, and 100."""
    stop = lambda c, p: F.struct(c.alias("c"), p.cast("double").alias("p"))
    given = F.array(stop(F.col("b"), F.lit(100)), stop(F.col("a"), F.lit(0)), stop(F.lit("#808080"), F.col("p_partkey") % 100))
    return C.stops(given, F.lit(""), F.lit(""))


@query(HEX_SQL + """SELECT p_partkey, '#' || lower(printf('%02x%02x%02x', CAST(floor(r / w + 0.5) AS BIGINT), CAST(floor(g / w + 0.5) AS BIGINT), CAST(floor(b / w + 0.5) AS BIGINT))) AS mean FROM (
  SELECT p_partkey, w0 + w1 + w2 AS w, xr * w0 + 128 * w1 + yr * w2 AS r, xg * w0 + 128 * w1 + yg * w2 AS g, xb * w0 + 128 * w1 + yb * w2 AS b FROM (
    SELECT *, greatest(1.0, p / 2.0) AS w0, greatest(1.0, p / 2.0 + (100 - p) / 2.0) AS w1, greatest(1.0, (100 - p) / 2.0) AS w2 FROM (SELECT *, p_partkey % 100 AS p FROM c)))""", plain_sql=True)
def gradient_mean(spark, d):
    return hexes(spark, d).select("p_partkey", C.mean_colour(three_stops()).alias("mean"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 100 >= 100 - p_partkey % 100 THEN 0 ELSE 1 END AS at FROM part", plain_sql=True)
def gradient_widest_gap(spark, d):
    return hexes(spark, d).select("p_partkey", C.widest_gap(three_stops()).alias("at"))


@query(HEX_SQL + "SELECT p_partkey, 'linear-gradient(' || (p_partkey % 360) || 'deg, ' || a || ' 0%, #808080 ' || (p_partkey % 100) || '%, ' || b || ' 100%' || ')' AS css FROM c", plain_sql=True)
def gradient_css(spark, d):
    return hexes(spark, d).select("p_partkey", C.gradient_css(three_stops(), F.lit("linear"), F.col("p_partkey") % 360).alias("css"))


@query(HEX_SQL + "SELECT p_partkey, array_to_string([a || '@0', b || '@33', '#808080@67', '#000000@100'][1:n], ' ') AS four FROM (SELECT *, 4 AS n FROM c)", plain_sql=True)
def spread_stops(spark, d):
    spread = C.spread(F.array("a", "b", F.lit("#808080"), F.lit("#000000")))
    return hexes(spark, d).select("p_partkey", F.array_join(F.transform(spread, lambda s: F.concat(s["c"], F.lit("@"), s["p"].cast("long").cast("string"))), " ").alias("four"))


@query(HEX_SQL + """SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 1, 2, 3, 4) THEN trim(given) ELSE 'none' END AS colour, CASE WHEN p_partkey % 8 IN (0, 1, 2, 3, 4) THEN trim(given) ELSE 'transparent' END AS plain FROM (
  SELECT *, CASE p_partkey % 8 WHEN 0 THEN a WHEN 1 THEN ' ' || upper(b) || ' ' WHEN 2 THEN 'rgba(' || xr || ', ' || xg || ',1,.5)' WHEN 3 THEN 'hsl(' || xb || 'deg 10% 20%)' WHEN 4 THEN 'Teal' WHEN 5 THEN '#ggg' WHEN 6 THEN 'red), url(x' ELSE '' END AS given FROM c)""", plain_sql=True)
def safe_colours(spark, d):
    k, rgb = F.col("p_partkey") % 8, C.hex_to_rgb("a")
    part = lambda f: rgb[f].cast("string")
    given = (
        F.when(k == 0, F.col("a")).when(k == 1, F.concat(F.lit(" "), F.upper("b"), F.lit(" "))).when(k == 2, F.concat(F.lit("rgba("), part("r"), F.lit(", "), part("g"), F.lit(",1,.5)")))
        .when(k == 3, F.concat(F.lit("hsl("), part("b"), F.lit("deg 10% 20%)"))).when(k == 4, "Teal").when(k == 5, "#ggg").when(k == 6, "red), url(x").otherwise("")
    )
    return hexes(spark, d).select("p_partkey", given.alias("given")).select("p_partkey", X.safe_colour("given", "none").alias("colour"), X.safe_colour("given").alias("plain"))


@query("SELECT p_partkey, greatest(1, CAST(floor(w * s + 0.5) AS BIGINT)) AS width, greatest(1, CAST(floor(h * s + 0.5) AS BIGINT)) AS height FROM (SELECT *, least(1.0, 1600.0 / greatest(w, h)) AS s FROM (SELECT p_partkey, CAST(p_size * 97 AS DOUBLE) AS w, CAST(p_partkey % 3000 + 1 AS DOUBLE) AS h FROM part))", plain_sql=True)
def downscale(spark, d):
    return table(spark, d, "part").select("p_partkey", C.downscale(F.col("p_size") * 97, F.col("p_partkey") % 3000 + 1).alias("s")).select("p_partkey", "s.width", "s.height")


from foliospark.plans import site_queries  # noqa: E402, F401  registers the queries on whole sites
