"""The site document: schema, defaults, reading, normalising and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import as_text, blank_to, clean_lines, detect_lang, entry_url, export_block, kind_of_body, text, title_of_file, trim, uid
from foliospark.operators.merge import fold_entries
from foliospark.operators.select import order_keys, visible

_STOPS = "array<struct<c:string,p:string>>"
#: Field, type and default of each settings block and of an entry's style.
STYLE_FIELDS = (
    ("preset", "string", "inherit"), ("font", "string", ""), ("size", "double", 1.0), ("weight", "double", 400.0), ("italic", "boolean", False), ("underline", "boolean", False),
    ("lineHeight", "double", 1.85), ("letterSpacing", "double", 0.0), ("align", "string", "left"), ("textColor", "string", ""), ("textShadow", "boolean", False),
    ("titleFont", "string", ""), ("titleSize", "double", 1.0), ("titleWeight", "double", 0.0), ("titleItalic", "boolean", False), ("titleUnderline", "boolean", False), ("titleColor", "string", ""), ("titleAlign", "string", ""),
    ("bgType", "string", "inherit"), ("bgColor", "string", "#101418"), ("gradStops", _STOPS, None), ("gradFrom", "string", "#1b2735"), ("gradTo", "string", "#090a0f"), ("gradAngle", "double", 160.0), ("gradKind", "string", "linear"),
    ("bgImage", "string", ""), ("bgDim", "double", 0.35), ("bgBlur", "double", 0.0),
    ("frame", "string", "none"), ("frameColor", "string", ""), ("frameWidth", "double", 2.0), ("frameRadius", "double", 14.0), ("framePad", "double", 24.0), ("frameStyle", "string", "solid"),
)
SITE_FIELDS = (
    ("name", "string", "My Writings"), ("nameGu", "string", ""), ("nameHi", "string", ""), ("tagline", "string", "Poems, blogs and quotes"), ("taglineGu", "string", ""), ("taglineHi", "string", ""),
    ("author", "string", ""), ("avatar", "string", ""), ("about", "string", ""), ("email", "string", ""), ("footer", "string", ""), ("links", "array<struct<label:string,url:string>>", None),
)
THEME_FIELDS = (
    ("preset", "string", "ink"), ("mode", "string", "auto"), ("accent", "string", "#B4763C"), ("bgType", "string", "preset"), ("bgColor", "string", ""), ("gradFrom", "string", ""), ("gradTo", "string", ""),
    ("gradAngle", "double", 160.0), ("gradStops", _STOPS, None), ("gradKind", "string", "linear"), ("bgImage", "string", ""), ("bgDim", "double", 0.45), ("bgBlur", "double", 0.0),
    ("fontEn", "string", "Fraunces"), ("fontGu", "string", "Hind Vadodara"), ("fontHi", "string", "Hind"), ("fontUi", "string", "Inter"), ("headEn", "string", ""), ("headGu", "string", ""), ("headHi", "string", ""),
    ("headWeight", "double", 620.0), ("baseSize", "double", 17.0), ("radius", "double", 18.0), ("cardStyle", "string", "paper"), ("density", "string", "comfortable"),
)
HERO_FIELDS = (("enabled", "boolean", True), ("title", "string", ""), ("subtitle", "string", ""), ("showAvatar", "boolean", True), ("align", "string", "center"), ("featuredId", "string", ""))
HOME_FIELDS = (
    ("layout", "string", "grid"), ("perPage", "double", 9.0), ("hero", HERO_FIELDS, None), ("tabs", "array<string>", ["all", "poems", "blogs", "quotes", "collections"]),
    ("showCounts", "boolean", True), ("showSearch", "boolean", True), ("showLangFilter", "boolean", True), ("sortBy", "string", "date-desc"),
)
FEEDBACK_FIELDS = (
    ("enabled", "boolean", True), ("endpoint", "string", ""), ("endpointKey", "string", ""), ("email", "string", ""), ("intro", "string", ""), ("askName", "boolean", True), ("askEmail", "boolean", True), ("askAbout", "boolean", True),
)
ADMIN_FIELDS = (("passSalt", "string", ""), ("passHash", "string", ""), ("iterations", "double", 250000.0))
PUBLISH_FIELDS = (("owner", "string", ""), ("repo", "string", ""), ("branch", "string", "main"), ("path", "string", "writings/data/content.json"))
ENTRY_FIELDS = (
    ("id", "string", ""), ("type", "string", "poem"), ("lang", "string", "gu"), ("title", "string", ""), ("body", "string", ""), ("excerpt", "string", ""), ("tags", "array<string>", None), ("collections", "array<string>", None),
    ("date", "string", None), ("pinned", "boolean", False), ("draft", "boolean", False), ("cover", "string", ""), ("credit", "string", ""), ("updatedAt", "string", ""), ("style", STYLE_FIELDS, None),
)
COLLECTION_FIELDS = (("id", "string", ""), ("name", "string", ""), ("desc", "string", ""), ("cover", "string", ""), ("accent", "string", ""), ("order", "double", 0.0))
BLOCKS = {"site": SITE_FIELDS, "theme": THEME_FIELDS, "home": HOME_FIELDS, "feedback": FEEDBACK_FIELDS, "admin": ADMIN_FIELDS, "publish": PUBLISH_FIELDS}
MOST_STOPS = 8


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()),
    _STOPS: T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("p", T.StringType())])),
    "array<struct<label:string,url:string>>": T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("url", T.StringType())])),
}


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k] if isinstance(k, str) else _struct(k)) for n, k, _ in fields])


SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("updatedAt", T.StringType()), *(T.StructField(b, _struct(f)) for b, f in BLOCKS.items()),
    T.StructField("entries", T.ArrayType(_struct(ENTRY_FIELDS))), T.StructField("collections", T.ArrayType(_struct(COLLECTION_FIELDS))),
])


def clean_stops(stops: Column) -> Column:
    """The first stops with a colour; positions as numbers from 0 to 100, 0 where they are none."""
    kept = F.slice(F.filter(F.coalesce(stops, F.array().cast(_STOPS)), lambda s: s["c"].isNotNull()), 1, MOST_STOPS)
    p = lambda s: F.coalesce(s["p"].try_cast("double"), F.lit(0.0))
    return F.transform(kept, lambda s: F.struct(s["c"].alias("c"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.nanvl(p(s), F.lit(0.0)))).alias("p")))


def filled(value: Column, fields) -> Column:
    """A struct with its defaults where it, or a field, is missing or null; arrays are taken whole."""
    out = []
    for name, kind, default in fields:
        v = value.getField(name)
        if not isinstance(kind, str):
            v = filled(v, kind)
        elif kind == _STOPS:
            v = clean_stops(v)
        elif kind.startswith("array"):
            v = F.coalesce(v, F.array(*map(F.lit, default or [])).cast(kind))
        elif default is not None:
            v = F.coalesce(v, F.lit(default).cast(kind))
        out.append(v.alias(name))
    return F.struct(*out)


def read_site(spark: SparkSession, path: str) -> DataFrame:
    """One row for each site document; what lacks entries or site settings is no site and gives no row."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).where("entries IS NOT NULL AND site IS NOT NULL")


def parse_site(raw: DataFrame, column: str = "json") -> DataFrame:
    """As ``read_site``, from a text column that stays, so that unknown fields are not lost."""
    return raw.withColumn("_doc", F.from_json(column, SCHEMA)).where("_doc.entries IS NOT NULL AND _doc.site IS NOT NULL").select(column, "_doc.*")


def normalise(sites: DataFrame, today: str) -> DataFrame:
    """Settings with all their defaults; version 1; missing lists are empty."""
    blocks = {b: filled(F.col(b), f) for b, f in BLOCKS.items()}
    lists = {c: F.coalesce(F.col(c), F.array().cast(sites.schema[c].dataType)) for c in ("entries", "collections")}
    return sites.withColumns(blocks | lists | {"version": F.lit(1), "updatedAt": text("updatedAt")})


def entries_of(sites: DataFrame, today: str) -> DataFrame:
    """The entries of a site in stored order; empty ids get one that does not change from run to run."""
    rows = sites.select(F.posexplode("entries").alias("pos", "e")).select(F.col("pos").cast("long").alias("pos"), filled(F.col("e"), ENTRY_FIELDS).alias("e")).select("pos", "e.*")
    return rows.withColumns({"id": blank_to(text("id"), uid("e_", F.col("pos").cast("string"), "title", "body")), "date": F.coalesce("date", F.lit(today))})


def collections_of(sites: DataFrame) -> DataFrame:
    rows = sites.select(F.posexplode("collections").alias("pos", "c")).select(F.col("pos").cast("long").alias("pos"), filled(F.col("c"), COLLECTION_FIELDS).alias("c")).select("pos", "c.*")
    return rows.withColumn("id", blank_to(text("id"), uid("c_", F.col("pos").cast("string"), "name")))


def layered(published: DataFrame, recent: DataFrame | None, now_ms: int, minutes: int = 15) -> DataFrame:
    """The published site, or our own last publish while that is fresh and the served one is older.

    recent: one row at most of savedAt (ms), at (time stamp) and the site's columns.
    """
    if recent is None:
        return published
    fresh = recent.where((F.lit(now_ms) - F.col("savedAt") < minutes * 60_000))
    served = published.agg(F.max(text("updatedAt")).alias("_served"))
    newer = fresh.join(served).where(text("_served") < text("at")).select(*published.columns)
    none = newer.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return newer.unionByName(published.join(none).select(*published.columns))


def current_entries(served: DataFrame, draft: DataFrame | None, base: DataFrame | None) -> DataFrame:
    """What an admin sees: the draft folded over the served entries, or these where there is no draft. For readers, the served ones."""
    return served if draft is None else fold_entries(draft, served, base).drop("action")


def to_document(sites: DataFrame, now: str, backup: bool = False) -> DataFrame:
    """``value``: the JSON of each site, nulls kept and the stamp renewed; a backup leaves out the passphrase settings."""
    rows = sites.withColumn("updatedAt", F.lit(now))
    names = [f.name for f in SCHEMA.fields if not (backup and f.name == "admin")]
    return rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def write_site(sites: DataFrame, path: str, now: str, backup: bool = False) -> None:
    """A new version in a folder of its own; readers change over when the writer's commit is done."""
    to_document(sites, now, backup).write.text(path)


def export_text(entries: DataFrame, is_admin: bool = False) -> DataFrame:
    """pos, block: every visible entry in the default order, as ``value``; joined by three line breaks on writing."""
    block = export_block("title", "type", "lang", "date", "body", "credit")
    return visible(entries, is_admin).orderBy(*order_keys()).select("pos", block.alias("value"))


def write_export(entries: DataFrame, path: str, is_admin: bool = False) -> None:
    """One part file after the other holds the export in order."""
    export_text(entries, is_admin).select("value").write.option("lineSep", "\n\n\n").text(path)


def entry_texts(entries: DataFrame, who: str, base_url: str, signature: bool = True, link: bool = True) -> DataFrame:
    """id, value: each entry as a text to copy."""
    url = entry_url(base_url, "id") if link else None
    return entries.select("id", as_text("title", "body", "credit", F.lit(who) if signature else None, url if signature else None).alias("value"))


def import_texts(spark: SparkSession, path: str, today: str) -> DataFrame:
    """A draft for each .txt file with words in it: title from the name, language from the script, kind from the lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("raw"))
    return import_drafts(files, today)


def import_drafts(files: DataFrame, today: str) -> DataFrame:
    """As ``import_texts`` from columns name and raw."""
    body = trim(clean_lines("raw"))
    rows = files.select(title_of_file("name").alias("title"), body.alias("body"), detect_lang("raw").alias("lang"), kind_of_body(body).alias("type"), "name").where("body <> ''")
    return rows.withColumns({"draft": F.lit(True), "date": F.lit(today), "id": uid("e_", "name", "body")}).drop("name")
