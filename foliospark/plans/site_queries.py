"""Queries over whole site documents, settings, styles and interface strings, with their SQL.

The documents are made from ``customer`` and ``nation``: some fields are missing,
null, of a wrong kind or unknown, by remainders of the key.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import colour as C
from foliospark.functions import i18n
from foliospark.functions import text as X
from foliospark.functions import theme as H
from foliospark.operators import changes, facets, merge, select
from foliospark.plans.catalogue import BRIEF, HEX_SQL, NOW, collections, entries, hexes, query, table, written
from foliospark.sources import site


def say(*parts: Column | str) -> Column:
    """Texts put together; a str is a literal, a column becomes text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def joined(pairs: Column) -> Column:
    """A map of properties as one text."""
    return F.array_join(F.transform(F.map_entries(pairs), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ";")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))


CUSTOMERS = "WITH c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer) "


def documents(rows: DataFrame) -> DataFrame:
    """json: a site document for each row of k, name, seg."""
    k, name, seg = F.col("k"), F.col("name"), F.col("seg")
    parts = [
        say('"version":7,"updatedAt":"2025-01-0', k % 9, 'T00:00:00.000Z","unknown":{"a":1}'),
        F.when(k % 7 != 0, say('"site":{"name":', F.when(k % 4 == 0, F.lit("null")).otherwise(say('"', name, '"')), ',"footer":"', k, '","links":[{"label":"', seg, '","url":"', F.when(k % 2 == 0, "").otherwise("https://x/"), '"},{"label":"","url":"u"}]}')),
        F.when(k % 11 != 0, say('"entries":[{"id":"a', k, '","body":"', name, '","tags":"x"},{"title":"', seg, '","tags":["', seg, '","t"],"pinned":true,"lang":"hi","type":null,"date":"2024-03-0', k % 9, '"}]')).otherwise('"entries":5'),
        say('"theme":{"radius":', k % 40, ',"gradStops":[{"c":"#111","p":-5},{"c":"#222","p":', k, '},{"p":4},{"c":"#333","p":"x"}]}'),
        F.when(k % 3 == 0, say('"home":{"perPage":', k % 5, ',"hero":{"align":"left"}},"collections":[{"id":"c","name":"', name, '"},{"name":"', seg, '","order":2}]')),
        F.when(k % 5 == 0, say('"admin":{"passHash":"h', k, '"}')),
        F.when(k % 5 == 1, say('"publish":{"owner":"o', k, '"}')),
    ]
    return rows.select(say("{", F.concat_ws(",", *parts), "}").alias("json"))


def sites(rows: DataFrame) -> DataFrame:
    return site.normalise(site.parse_site(documents(rows)), "2025-06-01")


GATE = "WHERE k % 7 <> 0 AND k % 11 <> 0"
SITE_SQL = "SELECT CAST(k AS BIGINT) AS k, CASE WHEN k % 4 = 0 THEN 'My Writings' ELSE name END AS name, '' AS author, seg || ' ' || CASE WHEN k % 2 = 0 THEN '' ELSE 'https://x/' END || '; u' AS links, CASE WHEN k % 2 = 0 THEN '' ELSE seg END AS full, CAST(k % 40 AS DOUBLE) AS radius, '#111@0 #222@' || least(100, k) || ' #333@0' AS stops, CAST(0.45 AS DOUBLE) AS dim, CASE WHEN k % 3 = 0 THEN CAST(k % 5 AS DOUBLE) ELSE 9.0 END AS per_page, 'all,poems,blogs,quotes,collections' AS tabs, CASE WHEN k % 3 = 0 THEN 'left' ELSE 'center' END AS align, TRUE AS feedback, 'main' AS branch, CASE WHEN k % 5 = 0 THEN 'h' || k ELSE '' END AS pass_hash, CAST(250000 AS DOUBLE) AS iterations, CAST(2 AS BIGINT) AS pieces, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS shelves, 1 AS version, {0} AS updated FROM c " + GATE
STAMP = "'2025-01-0' || k % 9 || 'T00:00:00.000Z'"


def site_fields(full: DataFrame) -> DataFrame:
    link = lambda x: F.concat_ws(" ", x["label"], x["url"])
    stop = lambda s: F.concat(s["c"], F.lit("@"), s["p"].cast("long").cast("string"))
    return full.select(
        F.col("site.footer").cast("long").alias("k"), "site.name", "site.author", F.array_join(F.transform("site.links", link), ";").alias("links"), F.array_join(X.full_links(F.col("site.links"))["label"], ";").alias("full"),
        "theme.radius", F.array_join(F.transform("theme.gradStops", stop), " ").alias("stops"), F.col("theme.bgDim").alias("dim"), F.col("home.perPage").alias("per_page"), F.array_join("home.tabs", ",").alias("tabs"),
        F.col("home.hero.align").alias("align"), F.col("feedback.enabled").alias("feedback"), "publish.branch", F.col("admin.passHash").alias("pass_hash"), "admin.iterations",
        F.size("entries").cast("long").alias("pieces"), F.size("collections").cast("long").alias("shelves"), "version", F.col("updatedAt").alias("updated"),
    )


@query(CUSTOMERS + SITE_SQL.format(STAMP), plain_sql=True)
def site_documents(spark, d):
    return site_fields(sites(customers(spark, d)))


@query(CUSTOMERS.replace("customer", "nation").replace("c_custkey", "n_nationkey").replace("c_name", "n_name").replace("c_mktsegment", "n_name") + SITE_SQL.format(f"'{NOW}'"), plain_sql=True)
def site_files(spark, d):
    """Written as files, a document each, and read back."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="foliospark-")
    path = f"{shared}/sites-{uuid.uuid4().hex}"
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_name").alias("seg"))
    made = site.to_document(sites(rows).drop("json"), NOW)
    made.withColumn("k", F.get_json_object("value", "$.site.footer")).write.partitionBy("k").text(path)
    return site_fields(site.normalise(site.read_site(spark, path).drop("k"), "2025-06-01"))


@query(CUSTOMERS + f"SELECT k, CASE WHEN k % 4 = 0 THEN 'My Writings' ELSE name END AS name, TRUE AS no_admin, CASE WHEN k % 5 = 1 THEN 'o' || k ELSE '' END AS owner, '{NOW}' AS updated, 'a' || k AS first_id, TRUE AS nulls_stay FROM c {GATE}", plain_sql=True)
def site_backup(spark, d):
    made = site.to_document(sites(customers(spark, d)).drop("json"), NOW, backup=True)
    part = lambda path: F.get_json_object("value", path)
    return made.select(part("$.site.footer").cast("long").alias("k"), part("$.site.name").alias("name"), part("$.admin").isNull().alias("no_admin"), part("$.publish.owner").alias("owner"), part("$.updatedAt").alias("updated"), part("$.entries[0].id").alias("first_id"), F.contains("value", F.lit('"excerpt":null')).alias("nulls_stay"))


_UID = "'{0}_' || sha256('1' || chr(31) || {1})[1:12]"


@query(CUSTOMERS + f"""SELECT CAST(0 AS BIGINT) AS pos, 'a' || k AS id, 'poem' AS type, 'gu' AS lang, '' AS title, name AS body, '' AS tags, '2025-06-01' AS date, FALSE AS pinned, FALSE AS draft, 'none' AS frame FROM c {GATE}
  UNION ALL SELECT 1, {_UID.format('e', "seg || chr(31) || ''")}, 'poem', 'hi', seg, '', seg || ',t', '2024-03-0' || k % 9, TRUE, FALSE, 'none' FROM c {GATE}""", plain_sql=True)
def site_entries(spark, d):
    found = site.entries_of(sites(customers(spark, d)), "2025-06-01")
    return found.select("pos", "id", "type", "lang", "title", "body", F.array_join("tags", ",").alias("tags"), "date", "pinned", "draft", F.col("style.frame").alias("frame"))


@query(CUSTOMERS + f"""SELECT CAST(0 AS BIGINT) AS pos, 'c' AS id, name, CAST(0 AS DOUBLE) AS "order" FROM c {GATE} AND k % 3 = 0 UNION ALL SELECT 1, {_UID.format('c', 'seg')}, seg, 2.0 FROM c {GATE} AND k % 3 = 0""", plain_sql=True)
def site_collections(spark, d):
    return site.collections_of(sites(customers(spark, d))).select("pos", "id", "name", "order")


@query(CUSTOMERS + "SELECT 'fresh and newer' AS layer, name FROM c WHERE k = 2 UNION ALL SELECT 'old', name FROM c WHERE k = 1 UNION ALL SELECT 'served is newer', name FROM c WHERE k = 1 UNION ALL SELECT 'none', name FROM c WHERE k = 1", plain_sql=True)
def site_layers(spark, d):
    """The served site is the first customer's, our last publish the second's."""
    full = sites(customers(spark, d))
    served, mine = full.where("site.footer = '1'"), full.where("site.footer = '2'").withColumn("savedAt", F.lit(1000))
    cases = {"fresh and newer": (2000, "2025-02"), "old": (1000 + 15 * 60_000, "2025-02"), "served is newer": (2000, "2025-01-00")}
    found = site.layered(served, None, 0).select(F.lit("none").alias("layer"), "site.name")
    for layer, (now, at) in cases.items():
        found = found.unionByName(site.layered(served, mine.withColumn("at", F.lit(at)), now).select(F.lit(layer).alias("layer"), "site.name"))
    return found


# ------------------------------------------------------------- settings
_FOLDED = {b: (2 + i, 3 + i) for i, b in enumerate(merge.BLOCKS)}


def _side(block: str, side: str) -> str:
    """SQL, for both engines, of one copy's JSON text of a block."""
    x, y = _FOLDED[block]
    return {
        "l": f"concat('{{\"a\":', CASE WHEN k % 2 = 0 THEN k % {x} ELSE 0 END, '}}')", "r": f"CASE WHEN k % 13 <> 0 THEN concat('{{\"a\":', k % {y}, '}}') END",
        "b": f"CASE WHEN k % 3 = 0 THEN concat('{{\"a\":', k % {x}, '}}') END", "d": "'{\"a\":0}'",
    }[side]


_TAKEN = {b: f"({_side(b, 'l')} = coalesce({_side(b, 'b')}, {_side(b, 'd')}) AND {_side(b, 'r')} IS NOT NULL AND {_side(b, 'r')} <> {_side(b, 'l')})" for b in merge.BLOCKS}


@query(CUSTOMERS + "SELECT k, " + ", ".join(f"CASE WHEN {_TAKEN[b]} THEN {_side(b, 'r')} ELSE {_side(b, 'l')} END AS {b}" for b in merge.BLOCKS) + ", concat_ws(',', " + ", ".join(f"CASE WHEN {_TAKEN[b]} THEN '{b}' END" for b in merge.BLOCKS) + ") AS settings FROM c", plain_sql=True)
def fold_settings(spark, d):
    rows = customers(spark, d).select("k", *(F.expr(_side(b, s)).alias(f"{s}_{b}") for b in merge.BLOCKS for s in "lrbd"))
    return merge.fold_settings(rows).withColumn("settings", F.array_join("settings", ","))


@query(CUSTOMERS + "SELECT k, CASE WHEN k % 2 = 0 THEN 'own' ELSE 'theirs' || k END AS hash, CASE WHEN k % 3 = 0 THEN 'me' ELSE 'them' END AS owner, CASE WHEN k % 4 = 0 THEN 'repo' || k ELSE 'site' END AS repo, 'main' AS branch, '' AS path FROM c", plain_sql=True)
def fold_admin_publish(spark, d):
    k = F.col("k")
    mine = F.struct(F.when(k % 3 == 0, "me").otherwise("").alias("owner"), F.when(k % 4 == 0, say("repo", k)).alias("repo"), F.lit("main").alias("branch"), F.lit("").alias("path"))
    theirs = F.struct(F.lit("them").alias("owner"), F.lit("site").alias("repo"), F.lit("other").alias("branch"), F.lit("").alias("path"))
    admin = merge.fold_admin(F.struct(F.when(k % 2 == 0, "own").alias("passHash")), F.struct(say("theirs", k).alias("passHash")))
    return customers(spark, d).select("k", admin["passHash"].alias("hash"), merge.fold_publish(mine, theirs).alias("p")).select("k", "hash", "p.*")


@query(CUSTOMERS + f"SELECT k, CASE WHEN k % 5 = 0 THEN 'h' || k ELSE 'mine' END AS hash, CASE WHEN k % 5 = 1 THEN 'o' || k ELSE 'me' END AS owner, TRUE AS replaced, CASE WHEN k % 4 = 0 THEN 'My Writings' ELSE name END AS name FROM c {GATE}", plain_sql=True)
def import_replace(spark, d):
    own = spark.createDataFrame([('{"site":{},"entries":[],"admin":{"passHash":"mine"},"publish":{"owner":"me"}}',)], "json string")
    found = merge.import_replace(site.normalise(site.parse_site(own), "2025-06-01"), sites(customers(spark, d)))
    return found.select(F.col("site.footer").cast("long").alias("k"), F.col("admin.passHash").alias("hash"), "publish.owner", "replaced", "site.name")


@query(CUSTOMERS + """SELECT k, concat_ws(', ', CASE WHEN k % 3 > 0 THEN 'kept ' || k % 3 || CASE WHEN k % 3 = 1 THEN ' piece' ELSE ' pieces' END || ' from your live site that this device did not have' END,
  CASE WHEN k % 4 > 0 THEN 'took the newer version of ' || k % 4 || CASE WHEN k % 4 = 1 THEN ' piece' ELSE ' pieces' END || ' edited on another device' END, CASE WHEN k % 5 = 0 THEN 'kept your live site settings' END) AS words FROM c""", plain_sql=True)
def merge_words(spark, d):
    k = F.col("k")
    return customers(spark, d).select("k", merge.describe_merge(k % 3, k % 4, F.when(k % 5 == 0, F.array(F.lit("site"))).otherwise(F.array().cast("array<string>"))).alias("words"))


@query(CUSTOMERS + """SELECT k, event, p OR dr AS can_edit, dr AND p AS can_discard, dr AND NOT ba AS needs_base,
  CASE WHEN event = 'edit' THEN TRUE WHEN event = 'publish' OR p THEN FALSE ELSE dr END AS has_draft, CASE WHEN event IN ('edit', 'publish') THEN TRUE WHEN p THEN FALSE ELSE ba END AS has_base, p OR event = 'publish' AS has_published
  FROM (SELECT k, k % 2 = 0 AS dr, k // 2 % 2 = 0 AS ba, k // 4 % 2 = 0 AS p, ['edit', 'publish', 'discard'][k % 3 + 1] AS event FROM c)""", plain_sql=True)
def draft_states(spark, d):
    k = F.col("k")
    bit = lambda n: F.floor(k / n) % 2 == 0
    state = F.struct(bit(1).alias("has_draft"), bit(2).alias("has_base"), bit(4).alias("has_published"))
    event = F.element_at(F.array(F.lit("edit"), F.lit("publish"), F.lit("discard")), (k % 3 + 1).cast("int"))
    rows = customers(spark, d).select("k", state.alias("s"), event.alias("event"))
    return rows.select("k", "event", changes.draft_state(F.col("s.has_draft"), F.col("s.has_base"), F.col("s.has_published")).alias("may"), changes.after_event(F.col("s"), "event").alias("then")).select("k", "event", "may.*", "then.*")


@query(CUSTOMERS + "SELECT k, CASE WHEN k % 5 = 4 OR k % 3 <> k % 2 THEN 't' || k % 2 END AS tag, k % 2 = 0 AND (k % 3 > 0 OR k % 4 > 0) AS reachable FROM c", plain_sql=True)
def toggles(spark, d):
    k = F.col("k")
    tag = select.toggled(F.when(k % 5 != 4, say("t", k % 3)), say("t", k % 2))
    return customers(spark, d).select("k", tag.alias("tag"), X.reachable(k % 2 == 0, F.when(k % 3 > 0, "e").otherwise(" "), F.when(k % 4 > 0, "m")).alias("reachable"))


# ------------------------------------------------- languages, dates, addresses
@query(CUSTOMERS + "SELECT k, CASE WHEN k % 3 = 0 THEN 'hi' WHEN k % 2 = 0 THEN 'gu' WHEN k % 5 = 0 THEN 'hi' ELSE 'en' END AS lang, CASE WHEN k % 4 = 0 THEN 'G ' || name WHEN k % 4 = 1 THEN name WHEN k % 4 = 2 THEN 'H' ELSE 'Site' END AS shown FROM c", plain_sql=True)
def interface_language(spark, d):
    k = F.col("k")
    browser = F.array(F.lit("fr-FR"), F.when(k % 2 == 0, "GU-in").otherwise("de"), F.when(k % 5 == 0, "hi").otherwise("es"))
    shown = i18n.localised(F.when(k % 4 < 2, F.col("name")).otherwise(""), {"gu": F.when(k % 4 == 0, say("G ", F.col("name"))), "hi": F.lit("H")}, F.when(k % 4 < 2, "gu").when(k % 4 == 2, "hi").otherwise("en"), "Site")
    return customers(spark, d).select("k", i18n.ui_language(F.when(k % 3 == 0, "hi").otherwise("xx"), browser).alias("lang"), shown.alias("shown"))


@query("SELECT c_custkey AS k, CASE WHEN n % 3 = 0 THEN 'H' || n WHEN n % 2 = 0 THEN 'E' || n ELSE 'n' || n END AS label FROM (SELECT c_custkey, c_nationkey AS n FROM customer)", plain_sql=True)
def interface_strings(spark, d):
    n = F.col("n_nationkey")
    names = table(spark, d, "nation").select(n, say("n", n).alias("key"))
    strings = names.where(n % 2 == 0).select(F.lit("en").alias("lang"), "key", say("E", n).alias("value")).unionByName(names.where(n % 3 == 0).select(F.lit("hi").alias("lang"), "key", say("H", n).alias("value"))).unionByName(names.select(F.lit("gu").alias("lang"), "key", say("G", n).alias("value")))
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), say("n", F.col("c_nationkey")).alias("key"))
    return i18n.translate_keys(keys, strings, "hi").select("k", "label")


def _months(lang: str) -> str:
    return "[" + ", ".join(f"'{m}'" for m in i18n.MONTHS[lang]) + "]"


_DAY = "CAST(CAST(date[9:10] AS INT) AS VARCHAR)"


@query("SELECT pos, " + ", ".join(f"CASE WHEN pos % 10 = 0 THEN 'no date' WHEN pos % 10 = 1 THEN '' ELSE {_DAY} || ' ' || {_months(x)}[CAST(date[6:7] AS INT)] || '{', ' if x == 'gu' else ' '}' || date[1:4] END AS {x}" for x in ("en", "hi", "gu")) + " FROM entries")
def dates_in_words(spark, d):
    given = F.when(F.col("pos") % 10 == 0, "no date").when(F.col("pos") % 10 == 1, "").otherwise(F.col("date"))
    return written(spark, d).select("pos", *(i18n.format_date(given, x).alias(x) for x in ("en", "hi", "gu")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS stamp, event_id * 1000 > 100000 AS fresh FROM events", plain_sql=True)
def stamps(spark, d):
    at = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", i18n.today(at).alias("day"), i18n.iso_now(at).alias("stamp"), i18n.is_fresh(F.lit(1_000_000), F.col("event_id") * 1000).alias("fresh"))


@query("SELECT o_orderkey AS k, CASE WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN CAST(floor(m / 60.0 + 0.5) AS BIGINT) || ' h ago' ELSE CAST(floor(m / 1440.0 + 0.5) AS BIGINT) || ' days ago' END AS age FROM (SELECT o_orderkey, greatest(1, o_orderkey % 5000) AS m FROM orders)", plain_sql=True)
def ages(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), i18n.relative_age(F.lit(10**12), F.lit(10**12) - F.col("o_orderkey") % 5000 * 60_000).alias("age"))


@query(CUSTOMERS + "SELECT k, ['entry', 'collection', 'feedback', 'about', 'admin', 'home', 'home', 'home'][k % 8 + 1] AS view, CASE k % 8 WHEN 0 THEN 'e' || k WHEN 1 THEN 'c/' || k ELSE '' END AS id FROM c", plain_sql=True)
def routes(spark, d):
    k = F.col("k")
    path = F.element_at(F.array(say("/e/e", k), say("/c/c/", k), *map(F.lit, ("/feedback", "/about", "/admin", "/", "", "/about/us"))), (k % 8 + 1).cast("int"))
    return customers(spark, d).select("k", X.route(path).alias("r")).select("k", "r.view", "r.id")


@query(CUSTOMERS + "SELECT k, CASE WHEN k % 4 < 3 THEN 'me' || k ELSE '' END AS owner, CASE k % 4 WHEN 0 THEN 'repo' WHEN 1 THEN 'me' || k || '.github.io' WHEN 2 THEN 'a' ELSE '' END AS repo, CASE k % 4 WHEN 0 THEN 'sub/dir/data/content.json' WHEN 1 THEN 'data/content.json' WHEN 2 THEN 'b/data/content.json' ELSE '' END AS path FROM c", plain_sql=True)
def publish_targets(spark, d):
    k = F.col("k")
    url = F.element_at(F.array(say("https://me", k, ".github.io/repo/sub/dir/index.html?q#/x"), say("https://me", k, ".github.io/"), say("https://me", k, ".github.io/a/b/"), say("https://me", k, ".example.org/a")), (k % 4 + 1).cast("int"))
    return customers(spark, d).select("k", X.publish_target(url).alias("t")).select("k", "t.*")


ERRORS = {"401": "sign in again", "403": "not allowed", "403 rate": "too often", "404": "not found", "409": "changed meanwhile", "422": "refused: {said}"}


@query(CUSTOMERS + "SELECT k, CASE k % 8 WHEN 0 THEN 'sign in again' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'too often' ELSE 'not allowed' END WHEN 2 THEN 'not found' WHEN 3 THEN 'changed meanwhile' WHEN 4 THEN 'refused: ' || said WHEN 5 THEN said ELSE said END AS message FROM (SELECT k, CASE WHEN k % 3 = 0 THEN 'API Rate Limit of ' || name WHEN k % 3 = 1 THEN 'HTTP ' || [401, 403, 404, 409, 422, 500, 502, 418][k % 8 + 1] ELSE name END AS said FROM c)", plain_sql=True)
def error_texts(spark, d):
    k = F.col("k")
    status = F.element_at(F.array(*map(F.lit, (401, 403, 404, 409, 422, 500, 502, 418))), (k % 8 + 1).cast("int"))
    return customers(spark, d).select("k", X.error_text(status, F.when(k % 3 == 0, say("API Rate Limit of ", F.col("name"))).when(k % 3 == 2, F.col("name")), ERRORS).alias("message"))


@query("""SELECT conv_id, turn, 'mailto:a%40b.c?subject=' || replace(url_encode('Feedback on Rooms — ' || role), '+', '%20') AS subject_of, CASE WHEN turn % 2 = 0 THEN 'Anonymous' ELSE 'R' || conv_id END AS name, CASE WHEN conv_id % 2 = 0 THEN 'r@x' ELSE '' END AS email, 'Feedback on Rooms — ' || role AS subject,
  'About: ' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN '' ELSE 'From: R' || conv_id || chr(10) END || CASE WHEN conv_id % 2 = 0 THEN 'Reply to: r@x' || chr(10) ELSE '' END || chr(10) || text || chr(10) || chr(10) || '— sent from Rooms' AS message, role AS about, 'Rooms' AS site, 'https://p/' AS page FROM conversations""", plain_sql=True)
def feedback_payloads(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    fields = F.struct(F.when(t % 2 != 0, say("R", c)).alias("name"), F.when(c % 2 == 0, "r@x").alias("email"), F.col("role").alias("about"), F.col("text").alias("message"))
    subject = F.regexp_extract(X.mailto(fields, "Rooms", "a@b.c"), "^(.*?)&body=", 1)
    return table(spark, d, "conversations").select("conv_id", "turn", subject.alias("subject_of"), X.feedback_payload(fields, "Rooms", "https://p/").alias("p")).select("conv_id", "turn", "subject_of", "p.*")


# ------------------------------------------------------------ styles and themes
def styles(spark: SparkSession, d: str) -> DataFrame:
    """k, a, b and a style for each part, of which some fields are as usual."""
    k, a, b = F.col("p_partkey"), F.col("a"), F.col("b")
    json = say(
        '{"size":', F.when(k % 2 == 0, F.lit("1.5")).otherwise("1"), ',"weight":', F.when(k % 3 == 0, F.lit("700")).otherwise("400"), ',"italic":', k % 2 == 0, ',"underline":', k % 3 == 0, ',"lineHeight":', F.when(k % 4 == 0, F.lit("0")).otherwise("2"),
        ',"align":"', F.element_at(F.array(F.lit("left"), F.lit("justify"), F.lit("center")), (k % 3 + 1).cast("int")), '","font":"', F.when(k % 5 == 0, "Lora").otherwise(""), '","textColor":"', F.when(k % 2 == 1, a).otherwise("bad("), '","textShadow":', k % 7 == 0,
        ',"titleFont":"', F.when(k % 4 == 0, "Mukta").otherwise(""), '","titleSize":', F.when(k % 3 == 1, F.lit("2")).otherwise("1"), ',"titleItalic":', k % 5 == 0,
        ',"bgType":"', F.element_at(F.array(F.lit("inherit"), F.lit("solid"), F.lit("gradient"), F.lit("image")), (k % 4 + 1).cast("int")), '","bgColor":"', a, '","gradFrom":"', a, '","gradTo":"', b, '","gradKind":"', F.when(k % 8 < 4, "linear").otherwise("radial"), '","gradAngle":', k % 360,
        ',"bgImage":"', F.when(k % 3 == 0, "http://no").otherwise("https://x/a.png"), '","bgDim":', F.when(k % 2 == 0, F.lit("7")).otherwise("0.5"), ',"bgBlur":99',
        ',"frame":"', F.element_at(F.array(F.lit("none"), F.lit("rule"), F.lit("double")), (k % 3 + 1).cast("int")), '","frameWidth":', k % 20, ',"frameRadius":', k % 60, ',"framePad":10,"frameStyle":"', F.when(k % 2 == 0, "dashed").otherwise("odd"), '"}',
    )
    return hexes(spark, d).select(k.alias("k"), "a", "b", site.filled(F.from_json(json, site._struct(site.STYLE_FIELDS)), site.STYLE_FIELDS).alias("style"))


STYLES_SQL = HEX_SQL + ", s AS (SELECT p_partkey AS k, * FROM c) "


def _present(pairs: list[tuple[str, str]]) -> str:
    """SQL of a text of the properties whose value is not null."""
    return "concat_ws(';', " + ", ".join(f"'{name}:' || {value}" for name, value in pairs) + ")"


_TEXT_CSS = _present([
    ("fontFamily", "CASE WHEN k % 5 = 0 THEN '''Lora'', var(--ff-en)' ELSE 'var(--ff-en)' END"), ("textAlign", "CASE k % 3 WHEN 1 THEN 'justify' WHEN 2 THEN 'center' END"), ("lineHeight", "CASE WHEN k % 4 <> 0 THEN '2' END"),
    ("fontSize", "CASE WHEN k % 2 = 0 THEN 'calc(var(--base-size) * 1.5)' END"), ("fontWeight", "CASE WHEN k % 3 = 0 THEN '700' END"), ("fontStyle", "CASE WHEN k % 2 = 0 THEN 'italic' END"),
    ("textDecoration", "CASE WHEN k % 3 = 0 THEN 'underline' END"), ("textUnderlineOffset", "CASE WHEN k % 3 = 0 THEN '0.22em' END"), ("textDecorationThickness", "CASE WHEN k % 3 = 0 THEN '0.06em' END"),
    ("textShadow", "CASE WHEN k % 7 = 0 THEN '0 2px 14px rgba(0,0,0,.45)' END"), ("color", "CASE WHEN k % 2 = 1 THEN a END"),
])
_TITLE_CSS = _present([
    ("fontFamily", "CASE WHEN k % 4 = 0 THEN '''Mukta'', var(--ff-en)' WHEN k % 5 = 0 THEN '''Lora'', var(--ff-en)' ELSE 'var(--fh-en)' END"), ("fontWeight", "'var(--head-weight)'"), ("--title-scale", "CASE WHEN k % 3 = 1 THEN '2' END"),
    ("fontStyle", "CASE WHEN k % 5 = 0 THEN 'italic' END"), ("textAlign", "CASE WHEN k % 3 = 2 THEN 'center' END"),
])
_FRAME_CSS = _present([("--fc", "'var(--accent)'"), ("--fw", "CASE WHEN k % 20 = 0 THEN '2' ELSE CAST(least(12, k % 20) AS VARCHAR) END || 'px'"), ("--fr", "least(40, k % 60) || 'px'"), ("--fp", "'10px'"), ("--fs", "CASE WHEN k % 2 = 0 THEN 'dashed' ELSE 'solid' END")])


@query(STYLES_SQL + f"SELECT k, {_TEXT_CSS} AS body, {_TITLE_CSS} AS title, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'framed frame-rule' ELSE 'framed frame-double' END AS frame, CASE WHEN k % 3 = 0 THEN '' ELSE {_FRAME_CSS} END AS vars FROM s", plain_sql=True)
def style_css(spark, d):
    frame = C.frame_style(F.col("style"))
    return styles(spark, d).select("k", joined(C.text_style(F.col("style"), F.lit("en"))).alias("body"), joined(C.title_style(F.col("style"), F.lit("en"))).alias("title"), frame["cls"].alias("frame"), joined(frame["vars"]).alias("vars"))


_LIN = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE power(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_DARK = "NOT (0.2126 * (" + _LIN.format("{0}") + ") + 0.7152 * (" + _LIN.format("{1}") + ") + 0.0722 * (" + _LIN.format("{2}") + ") > 0.45)"
_MEAN = [f"floor(({x} + {y}) / 2.0 + 0.5)" for x, y in (("xr", "yr"), ("xg", "yg"), ("xb", "yb"))]


@query(STYLES_SQL + f"""SELECT k, CASE k % 4 WHEN 1 THEN 'none' WHEN 2 THEN CASE WHEN k % 8 < 4 THEN 'linear-gradient(' || k % 360 || 'deg, ' ELSE 'radial-gradient(circle at 50% 45%, ' END || a || ' 0%, ' || b || ' 100%)'
  WHEN 3 THEN CASE WHEN k % 3 <> 0 THEN 'linear-gradient(rgba(0,0,0,0.5), rgba(0,0,0,0.5)), url("https://x/a.png")' END END AS image, CASE k % 4 WHEN 1 THEN a WHEN 2 THEN a WHEN 3 THEN CASE WHEN k % 3 <> 0 THEN '#111111' END END AS color,
  CAST(CASE WHEN k % 4 IN (1, 2) THEN 0 WHEN k % 4 = 3 AND k % 3 <> 0 THEN 40 END AS DOUBLE) AS blur, CASE k % 4 WHEN 1 THEN {_DARK.format('xr', 'xg', 'xb')} WHEN 2 THEN {_DARK.format(*_MEAN)} WHEN 3 THEN CASE WHEN k % 3 <> 0 THEN TRUE END END AS dark,
  CASE WHEN k % 4 IN (1, 2) THEN FALSE WHEN k % 4 = 3 AND k % 3 <> 0 THEN TRUE END AS is_image FROM s""", plain_sql=True)
def style_backgrounds(spark, d):
    return styles(spark, d).select("k", C.background(F.col("style")).alias("b")).select("k", "b.image", "b.color", "b.blur", "b.dark", "b.is_image")


@query(STYLES_SQL + "SELECT k, 'deep' AS preset, b AS first, a AS last, 'gradient' AS kind, '10' AS angle FROM s", plain_sql=True)
def look_presets(spark, d):
    stop = lambda c, p: F.struct(F.col(c).alias("c"), F.lit(float(p)).alias("p"))
    look = {"preset": F.lit("deep"), "bgType": F.lit("gradient"), "gradAngle": F.lit(10.0), "gradStops": F.array(stop("a", 90), stop("b", 5))}
    return styles(spark, d).select("k", changes.apply_look(F.col("style"), look).alias("s")).select("k", "s.preset", F.col("s.gradFrom").alias("first"), F.col("s.gradTo").alias("last"), F.col("s.bgType").alias("kind"), F.col("s.gradAngle").cast("long").cast("string").alias("angle"))


PALETTE = ("bg", "bg2", "surface", "surface2", "border", "text", "dim", "faint", "accent")
SYSTEM = {"gu": "Noto Gu", "hi": "Noto Hi", "": "system-ui"}


@query(STYLES_SQL + """SELECT k, mode, 'p' || CASE WHEN k % 3 = 2 THEN 0 ELSE k % 3 END || mode AS bg, CASE WHEN k % 2 = 0 THEN a ELSE '#abcdef' END AS accent, CASE WHEN k % 40 = 0 THEN 18 ELSE k % 40 END || 'px' AS radius, CASE WHEN k % 9 = 0 THEN '17px' ELSE (10 + k % 9) || 'px' END AS size,
  'data-mode:' || mode || ';data-preset:p' || k % 3 || ';data-card:' || CASE WHEN k % 2 = 0 THEN 'flat' ELSE 'paper' END || ';data-density:comfortable' AS attributes, CASE WHEN k % 2 = 0 THEN '"Lora", serif' ELSE CASE k % 3 WHEN 0 THEN 'Noto Gu' WHEN 1 THEN 'Noto Hi' ELSE 'system-ui' END END AS fonts
  FROM (SELECT *, CASE k % 5 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' WHEN 2 THEN 'dark' WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'dark' ELSE 'light' END ELSE 'light' END AS mode FROM s)""", plain_sql=True)
def page_themes(spark, d):
    k = F.col("k")
    mode = H.resolve_mode(F.when(k % 5 == 0, "dark").when(k % 5 == 1, "light").otherwise(""), F.when(k % 5 == 2, "dark").when(k % 5 == 3, "auto").otherwise("odd"), k % 2 == 0)
    palette = lambda i, m: F.struct(*(F.lit("#abcdef" if x == "accent" else f"p{i}{m}").alias(x) for x in PALETTE))
    presets = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(f"p{i}").alias("id"), F.lit(m).alias("mode"), palette(i, m).alias("palette")) for i in (0, 1) for m in ("dark", "light")))))
    theme = F.struct(F.when(k % 2 == 0, F.col("a")).otherwise("url(x)").alias("accent"), (k % 40).cast("string").alias("radius"), F.when(k % 9 == 0, "x").otherwise((10 + k % 9).cast("string")).alias("baseSize"), F.lit(None).cast("double").alias("headWeight"), F.when(k % 2 == 0, "flat").alias("cardStyle"), F.lit("").alias("density"))
    rows = H.with_palette(styles(spark, d).select("k", "a", say("p", k % 3).alias("preset"), mode.alias("mode")), presets, "p0")
    found = rows.select("k", "mode", H.page_variables(theme, F.col("palette"), F.col("mode")).alias("v"), H.page_attributes(theme, "preset", "mode").alias("t"))
    stack = H.font_stack(F.lit("Lora"), F.when(k % 2 == 0, "serif"), F.element_at(F.array(F.lit("gu"), F.lit("hi"), F.lit("en")), (k % 3 + 1).cast("int")), SYSTEM)
    return found.select("k", "mode", F.col("v")["--bg"].alias("bg"), F.col("v")["--accent"].alias("accent"), F.col("v")["--radius"].alias("radius"), F.col("v")["--base-size"].alias("size"), joined(F.col("t")).alias("attributes"), stack.alias("fonts"))


@query("SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey % 3 = 1", plain_sql=True)
def fonts_by_script(spark, d):
    fonts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.element_at(F.array(F.lit("en"), F.lit("gu"), F.lit("hi")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("script"))
    return H.fonts_for(fonts, "gu").select("k", "name")


@query("""SELECT k, w / 2 - dx * half AS x0, h / 2 - dy * half AS y0, w / 2 + dx * half AS x1, h / 2 + dy * half AS y1, (w - 300 * s) / 2 AS x, (h - 200 * s) / 2 AS y, 300 * s AS iw, 200 * s AS ih, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 16 ELSE 0 END AS DOUBLE) AS t, CAST(CASE k % 3 WHEN 0 THEN 12 WHEN 1 THEN 16 ELSE 0 END AS DOUBLE) AS l, w * 0.048 * greatest(0.6, least(2.0, k % 5 / 2.0)) AS size FROM (
  SELECT *, (abs(w * dx) + abs(h * dy)) / 2 AS half, greatest(w / 300, h / 200) AS s FROM (SELECT p_partkey AS k, CAST(p_size * 13 AS DOUBLE) AS w, CAST(p_partkey % 500 + 1 AS DOUBLE) AS h, sin(radians(CASE WHEN p_partkey % 360 = 0 THEN 160 ELSE p_partkey % 360 END)) AS dx, -cos(radians(CASE WHEN p_partkey % 360 = 0 THEN 160 ELSE p_partkey % 360 END)) AS dy FROM part))""", plain_sql=True)
def geometry(spark, d):
    k, w, h = F.col("k"), F.col("w"), F.col("h")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 13).alias("w"), (F.col("p_partkey") % 500 + 1).alias("h"))
    inset = H.frame_insets(F.element_at(F.array(F.lit("rule"), F.lit("double"), F.lit("none")), (k % 3 + 1).cast("int")), F.lit(10.0), F.lit(2.0), F.lit(1.0))
    found = rows.select("k", C.gradient_line(k % 360, w, h).alias("g"), C.cover_fit(F.lit(300), F.lit(200), w, h).alias("c"), inset.alias("i"), H.body_size(w, k % 5 / 2).alias("size"))
    return found.select("k", "g.*", "c.x", "c.y", F.col("c.w").alias("iw"), F.col("c.h").alias("ih"), "i.t", "i.l", "size")


@query(CUSTOMERS + "SELECT k, CAST(CASE WHEN k % 7 IN (0, 1) AND k > 0 THEN k WHEN k % 7 = 5 THEN -1.5 ELSE 9 END AS DOUBLE) AS n, greatest(10.0, least(100.0, CAST(k AS DOUBLE))) AS clamped FROM c", plain_sql=True)
def lenient_numbers(spark, d):
    k = F.col("k")
    given = F.element_at(F.array(say(" ", k, " "), say("0x", F.hex(k)), F.lit("abc"), F.lit(""), F.lit(None).cast("string"), F.lit("-1.5"), F.lit("0")), (k % 7 + 1).cast("int"))
    return customers(spark, d).select("k", C.number(given, 9).alias("n"), C.clamp(k.cast("double"), 10, 100).alias("clamped"))


# ------------------------------------------------------------------ lists
@query("""SELECT c.id, coalesce(p.pieces, '') AS pieces, CASE WHEN n > 12 THEN '+ ' || (n - 12) || ' more' ELSE '' END AS more FROM collections c LEFT JOIN (SELECT cid, count(*) AS n, string_agg(title, chr(31) ORDER BY pos) FILTER (r <= 12) AS pieces FROM (SELECT pos, title, cid, row_number() OVER (PARTITION BY cid ORDER BY pos) AS r FROM (SELECT pos, title, unnest(list_distinct(collections)) AS cid FROM (SELECT pos, CASE WHEN title = '' THEN id ELSE title END AS title, collections FROM entries))) GROUP BY cid) p ON p.cid = c.id""")
def collection_pieces(spark, d):
    e = written(spark, d).withColumn("title", X.blank_to(F.col("title"), F.col("id")))
    return facets.collection_pieces(e, collections(spark)).select("id", F.array_join("pieces", "\x1f").alias("pieces"), "more")


@query("SELECT pos, CASE WHEN title = '' THEN id ELSE title END AS label FROM shown ORDER BY pinned DESC, date DESC, pos LIMIT 200")
def feedback_options(spark, d):
    return facets.feedback_options(entries(spark, d).withColumn("title", X.blank_to(F.col("title"), F.col("id"))))


@query("SELECT id, array_to_string(list_concat(CASE WHEN tags[1] = 'src1' THEN tags[2:] ELSE tags END, [t]), ',') AS tags, typed FROM (SELECT id, list_append(tags, 'src1') AS tags, 'new' || pos % 3 AS t, 'a' || pos || ',b c' AS typed FROM entries)".replace("CASE WHEN tags[1] = 'src1' THEN tags[2:] ELSE tags END", "list_concat(tags[1:list_position(tags, 'src1') - 1], tags[list_position(tags, 'src1') + 1:])"))
def tag_edits(spark, d):
    """The first 'src1' is taken out of the tags, a new one is added twice, and a typed list is split."""
    e = entries(spark, d).withColumn("tags", F.array_append("tags", F.lit("src1")))
    new = say("new", F.col("pos") % 3)
    typed = merge.split_tags(say(" a", F.col("pos"), ", ,b c,a", F.col("pos"), ","))
    return e.select("id", F.array_join(merge.set_add(merge.set_add(merge.set_remove(F.col("tags"), F.lit("src1")), new), new), ",").alias("tags"), F.array_join(typed, ",").alias("typed"))


@query(f"SELECT {', '.join(BRIEF)} FROM entries WHERE pinned OR list_contains(collections, 'c_2')")
def base_lookup(spark, d):
    """Entries that a map of ids has, by the map's keys."""
    e = entries(spark, d)
    known = F.map_from_arrays(F.col("collections"), F.transform("collections", lambda x: F.lit(True)))
    return e.where(F.col("pinned") | F.map_contains_key(known, "c_2")).select(*BRIEF)
