"""The site document: gate, defaults, export and import."""

import json

from pyspark.sql import functions as F

from foliospark.operators import select
from foliospark.sources import site


def parsed(spark, *documents):
    rows = [(i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate(documents)]
    return site.parse_site(spark.createDataFrame(rows, "i int, json string").select("json"))


def test_gate(spark):
    assert parsed(spark, {}, [], "null", {"entries": []}, {"site": {}}, {"entries": 5, "site": {}}, "not json").count() == 0
    assert parsed(spark, {"entries": [], "site": {}}).count() == 1


def test_defaults(spark):
    doc = {"version": 9, "site": {"name": None, "author": ""}, "home": {"perPage": 0, "hero": {"align": "left"}}, "collections": None, "unknown": 1, "entries": [
        {"body": "only"}, {"id": "x", "tags": "x", "collections": None, "style": "x", "pinned": True, "lang": ""},
        {"id": "s", "style": {"gradStops": [{"c": f"#{k}", "p": k} for k in range(9)], "size": 2}}, {"id": "p", "style": {"gradStops": [{"c": "#1", "p": -5}, {"c": "#2", "p": 250}, {"c": "#3", "p": "abc"}, {"p": 4}]}},
    ]}
    full = site.normalise(parsed(spark, doc), "2025-01-01")
    r = full.first()
    assert (r.version, r.updatedAt, r.site.name, r.site.author, r.home.perPage, r.home.hero.align, r.home.hero.enabled, r.publish.branch, r.collections) == (1, "", "My Writings", "", 0.0, "left", True, "main", [])
    assert r.home.tabs == ["all", "poems", "blogs", "quotes", "collections"] and "unknown" in r.json
    e = site.entries_of(full, "2025-01-01").orderBy("pos").collect()
    assert (e[0].type, e[0].lang, e[0].tags, e[0].date, e[0].draft, e[0].style.frame) == ("poem", "gu", [], "2025-01-01", False, "none") and e[0].id.startswith("e_")
    assert e[1].tags == [] and e[1].pinned and e[1].lang == "" and len(e[2].style.gradStops) == 8 and e[2].style.size == 2
    assert [s.p for s in e[3].style.gradStops] == [0, 100, 0]


def test_round_trip_and_backup(spark, tmp_path):
    doc = {"site": {"name": "S"}, "entries": [{"id": "a", "title": "T", "body": "b"}], "collections": [{"id": "c", "name": "C"}], "admin": {"passHash": "h"}}
    full = site.normalise(parsed(spark, doc), "d").drop("json")
    site.write_site(full, f"{tmp_path}/v1", "2025-01-01T00:00:00.000Z")
    again = site.read_site(spark, f"{tmp_path}/v1")
    assert again.first().admin.passHash == "h" and again.first().updatedAt == "2025-01-01T00:00:00.000Z"
    assert site.collections_of(again).first().name == "C"
    backup = json.loads(site.to_document(full, "t", backup=True).first().value)
    assert "admin" not in backup and backup["publish"]["branch"] == "main"


def test_layers(spark):
    published = spark.createDataFrame([("2025-01-01", "old")], "updatedAt string, title string")
    recent = spark.createDataFrame([(1000, "2025-01-02", "2025-01-02", "mine")], "savedAt long, at string, updatedAt string, title string")
    pick = lambda now: site.layered(published, recent, now).first().title
    assert pick(2000) == "mine" and pick(1000 + 15 * 60_000) == "old" and site.layered(published, None, 0).first().title == "old"
    newer = published.withColumn("updatedAt", F.lit("2025-01-03"))
    assert site.layered(newer, recent, 2000).first().title == "old"


def test_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my-poem.txt").write_text("line\r\nline\r\n", newline="")
    (tmp_path / "in" / "empty.txt").write_text(" \n")
    r = site.import_texts(spark, f"{tmp_path}/in", "2025-01-01").collect()
    assert [(x.title, x.body, x.type, x.draft) for x in r] == [("my poem", "line\nline", "poem", True)]
    rows = [("a", "poem", "en", "2024-01-01", "A", "x", "", [], False, False, 0), ("b", "quote", "en", "2024-02-01", "", "y", "by", [], False, False, 1), ("d", "poem", "en", "2025-01-01", "D", "z", "", [], False, True, 2)]
    entries = spark.createDataFrame(rows, "id string, type string, lang string, date string, title string, body string, credit string, tags array<string>, pinned boolean, draft boolean, pos long")
    site.write_export(entries, f"{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text.startswith("── Quote ──\nQuote · EN · 2024-02-01\n\ny\n\nby\n\n\n── A ──") and "── D ──" not in text
    assert site.entry_texts(entries, "me", "u/").orderBy("id").first().value == "A\n\nx\n\n— me\nu/#/e/a"
    assert [r.id for r in select.select(entries, is_admin=True, query="  ").orderBy("pos").collect()] == ["a", "b", "d"]


def test_order_of_titles(spark):
    titles = ["क", "b", "B", "a", "A", "9", "10", "Z", "é", " z", "ક"]
    df = spark.createDataFrame([(t, False, i) for i, t in enumerate(titles)], "title string, pinned boolean, pos long")
    assert [r.title for r in df.orderBy(*select.order_keys("title")).collect()] == [" z", "10", "9", "a", "A", "b", "B", "é", "Z", "क", "ક"]
    assert select.toggled_tag("x", "x") is None and select.toggled_tag("x", "y") == "y"
