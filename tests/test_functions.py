"""Golden values of the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import colour as C
from foliospark.functions import i18n
from foliospark.functions import text as X


def values(spark, rows, *columns, schema="a string, b string, c string"):
    width = schema.count(",") + 1
    padded = [(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(padded, "i int, " + schema).orderBy("i").select(*columns)
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.collect()]


def test_plain_and_html(spark):
    rows = [("a **b** c",), ("2 * 3",), ("****",), ("**a",), ("****a**",), ("**a __b** c__",), ("**x\ny**",), (None,), ("*i* <b> __u__",)]
    assert values(spark, rows, X.plain("a")) == ["a b c", "2 * 3", "****", "**a", "****a**", "a b c", "**x\ny**", "", "i <b> u"]
    assert values(spark, rows[:1] + rows[5:6] + rows[8:], X.html("a")) == ["a <strong>b</strong> c", "<strong>a <u>b</u></strong><u> c</u>".replace("<strong>a <u>b</u></strong>", "<strong>a </strong><strong><u>b</u></strong>"), "<em>i</em> &lt;b&gt; <u>u</u>"]
    assert values(spark, rows, X.has_markup("a")) == [True, False, False, False, False, True, False, False, True]


def test_plain_keeps_all_but_pairs_of_markers(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("**__ab \n", k=rng.randrange(14))),) for _ in range(3000)]
    for (given,), found in zip(rows, values(spark, rows, X.plain("a")), strict=True):
        assert [c for c in given if c not in "*_"] == [c for c in found if c not in "*_"]
        for line, left in zip(given.split("\n"), found.split("\n"), strict=True):
            stars, lines = line.count("*") - left.count("*"), line.count("_") - left.count("_")
            assert stars % 2 == 0 and lines % 4 == 0 and (line.count("*") > 1 or not stars)
    joined = F.array_join(F.transform(X.tokens("a"), lambda t: t["t"]), "")
    assert values(spark, rows, joined) == values(spark, rows, X.plain("a"))


def test_language(spark):
    rows = [("કવિતા",), ("कविता",), ("કવિ",), ("hello",), ("કવિતકવિત"[:4] + "कवित"[:4],), (None,)]
    assert values(spark, rows, X.detect_lang("a")) == ["gu", "hi", "en", "en", "en", "en"]
    assert values(spark, [("ab",), ("twelve letters",)], X.auto_lang("a", F.lit("gu"))) == ["gu", "en"]
    assert values(spark, [("hi", None), ("xx", None), (None, None)], i18n.ui_language("a", F.array(F.lit("fr-FR"), F.lit("GU-in")))) == ["hi", "gu", "gu"]


def test_stats_and_preview(spark):
    rows = [("",), ("  \n ",), ("w " * 269,), ("w " * 270,), ("w " * 450,)]
    assert values(spark, rows, X.words("a"), X.minutes(X.words("a"))) == [(0, 1), (0, 1), (269, 1), (270, 2), (450, 3)]
    poem, prose = "\n".join("abcdefg"), "x" * 241
    rows = [("poem", poem, None), ("poem", poem[:11], None), ("blog", prose, ""), ("blog", "a  **b**\n c", None), ("quote", "q", "said")]
    assert values(spark, rows, X.preview("a", "b", "c")) == ["a\nb\nc\nd\ne\nf\n…", "a\nb\nc\nd\ne\nf", "x" * 240 + "…", "a b c", "said"]


def test_guards(spark):
    rows = [("#abc",), ("#ggg",), ("red",), ("x), url(y",), (" rgba(1, 2,3,.5) ",), (None,)]
    assert values(spark, rows, X.safe_colour("a", "")) == ["#abc", "", "red", "", "rgba(1, 2,3,.5)", ""]
    assert values(spark, rows[1:2], X.safe_colour("a")) == ["transparent"]
    rows = [("http://x",), ("https://x/a.png",), ("data:image/svg+xml;base64,AA==",), ("//x",), ("./a.png",), ("javascript:1",), ("https://x/(a)",), ("",)]
    assert values(spark, rows, X.safe_image_url("a")) == ["", "https://x/a.png", "", "", "./a.png", "", "", ""]
    assert values(spark, rows, X.safe_url("a")) == ["http://x", "https://x/a.png", "data:image/svg+xml;base64,AA==", "", "./a.png", "", "https://x/(a)", ""]
    assert values(spark, [("a/b: c", "poem", "2024-01-01"), ("", "blog", "d"), ("??", "x", "d")], X.safe_filename("a", "b", "c")) == ["ab-c-2024-01-01", "Blog-d", "writing-d"]
    assert values(spark, [("a b!'()*~é&",)], X.encode_component("a")) == ["a%20b!'()*~%C3%A9%26"]
    assert values(spark, [("é😀" * 60,)], X.from_base64(X.to_base64("a"))) == ["é😀" * 60]


def test_colours(spark):
    assert values(spark, [("#000000", "#ffffff"), ("#fff", "zzz"), ("#f00", "#00f")], C.mix("a", "b", 0.5)) == ["#808080", "#fff", "#800080"]
    assert values(spark, [("#ffffff",), ("#000000",), ("no",), (None,)], C.is_light("a")) == [True, False, True, True]
    for n, want in ((1, [0]), (3, [0, 50, 100]), (4, [0, 33, 67, 100])):
        assert values(spark, [("x",)], C.spread(F.array(*[F.lit("#000")] * n))["p"]) == [want]
    assert values(spark, [("#123456",), ("123",), ("zzz",)], C.rgba("a", 0.5)) == ["rgba(18,52,86,0.5)", "rgba(17,34,51,0.5)", "rgba(0,0,0,0.5)"]
    none = F.lit(None).cast("array<struct<c:string,p:string>>")
    pair = C.stops(none, F.col("a"), F.col("b"))
    assert values(spark, [("#fff", "#fff"), ("", ""), ("bad(", "#000")], C.gradient_is_dark(pair)) == [False, True, True]
    assert values(spark, [("#fff", "red")], C.gradient_css(pair, F.lit("radial"), F.lit(0))) == ["radial-gradient(circle at 50% 45%, #fff 0%, red 100%)"]
    assert values(spark, [("0",), ("x",), ("0x10",)], C.number("a", 18)) == [18, 18, 16]
    assert values(spark, [("4000", "1000")], C.downscale("a", "b")) == [(1600, 400)]
    line = values(spark, [("90", "100", "50")], C.gradient_line("a", "b", "c"))[0]
    assert [round(v, 6) for v in line] == [0, 25, 100, 25]
    assert tuple(values(spark, [("100", "100", "200")], C.cover_fit("a", "b", "c", F.lit(100)))[0]) == (0, -50, 200, 200)


def test_dates_and_ages(spark):
    rows = [("2024-03-05",), ("bad",), ("",), (None,)]
    assert values(spark, rows, i18n.format_date("a")) == ["5 March 2024", "bad", "", ""]
    assert values(spark, rows[:1], i18n.format_date("a", "hi"), i18n.format_date("a", "gu")) == [("5 मार्च 2024", "5 માર્ચ, 2024")]
    now = F.lit(100 * 86_400_000)
    ages = [values(spark, [("x",)], i18n.relative_age(now, now - F.lit(m * 60_000)))[0] for m in (0, 59, 60, 1439, 1440, 3000)]
    assert ages == ["1 min ago", "59 min ago", "1 h ago", "24 h ago", "1 days ago", "2 days ago"]
    assert values(spark, [("x",)], i18n.is_fresh(now, now - 899_999), i18n.is_fresh(now, now - 900_000)) == [(True, False)]


def test_strings(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    table = spark.createDataFrame([("en", "a", "A"), ("hi", "a", "ए"), ("en", "b", "B"), ("gu", "c", "સ")], "lang string, key string, value string")
    assert {r.key: r.label for r in i18n.translate_keys(keys, table, "hi").collect()} == {"a": "ए", "b": "B", "c": "c"}
    assert values(spark, [("N", "G", "gu"), ("N", "", "gu"), ("", "", "en")], i18n.localised("a", {"gu": "b"}, "c", "Site")) == ["G", "N", "Site"]


def test_messages_routes_errors(spark):
    fields = F.struct(F.col("a").alias("name"), F.lit("").alias("email"), F.col("b").alias("about"), F.col("c").alias("message"))
    assert values(spark, [("N", "", "hey"), (None, None, "x")], X.feedback_body(fields, "S")) == ["From: N\n\nhey\n\n— sent from S", "x\n\n— sent from S"]
    assert values(spark, [(None, "P", "m")], X.mailto(fields, "S", "a@b.c")) == ["mailto:a%40b.c?subject=Feedback%20on%20S%20%E2%80%94%20P&body=About%3A%20P%0A%0Am%0A%0A%E2%80%94%20sent%20from%20S"]
    assert values(spark, [(None, "P", "m")], X.feedback_payload(fields, "S", "u")["name"]) == ["Anonymous"]
    assert values(spark, [("", " "), ("e", ""), ("", "m")], X.reachable(F.lit(True), "a", "b")) == [False, True, True]
    assert [tuple(r) for r in values(spark, [("/e/x1",), ("/c/y",), ("/about",), ("",), ("/zzz",)], X.route("a"))] == [("entry", "x1"), ("collection", "y"), ("about", ""), ("home", ""), ("home", "")]
    url = [("https://me.github.io/repo/sub/index.html?q#/x",), ("https://me.github.io/",), ("https://other.org/a",)]
    assert [tuple(r) for r in values(spark, url, X.publish_target("a"))] == [("me", "repo", "sub/data/content.json"), ("me", "me.github.io", "data/content.json"), ("", "", "")]
    texts = {"401": "rejected", "403 rate": "later", "403": "not allowed", "422": "refused: {said}"}
    assert values(spark, [("401", ""), ("403", "API rate limit"), ("403", "x"), ("422", "no"), ("500", None)], X.error_text(F.col("a").cast("int"), "b", texts)) == ["rejected", "later", "not allowed", "refused: no", "HTTP 500"]


def test_texts(spark):
    row = [("T", " *b* ", "c")]
    assert values(spark, row, X.as_text("a", "b", "c", F.lit("me"), F.lit("u"))) == ["T\n\nb\n\nc\n\n— me\nu"]
    assert values(spark, row, X.export_block("a", F.lit("poem"), F.lit("en"), F.lit("d"), "b", "c")) == ["── T ──\nPoem · EN · d\n\n*b*\n\nc"]
    assert values(spark, [("my-old__poem.TXT",)], X.title_of_file("a")) == ["my old poem"]
    assert values(spark, [("\n".join("x" * 14),), ("\n".join("x" * 15),)], X.kind_of_body("a")) == ["poem", "blog"]
    assert values(spark, [("x",), ("x",)], X.uid("e_", "a")) in ([v] * 2 for v in values(spark, [("x",)], X.uid("e_", "a")))


@pytest.mark.parametrize("kind,want", [("solid", ("none", "#101010", True)), ("inherit", None), ("image", ('linear-gradient(rgba(0,0,0,1), rgba(0,0,0,1)), url("https://x/a.png")', "#111111", True))])
def test_background(spark, kind, want):
    style = F.struct(F.lit(kind).alias("bgType"), F.lit("#101010").alias("bgColor"), F.lit(None).cast("array<struct<c:string,p:double>>").alias("gradStops"), F.lit("").alias("gradFrom"), F.lit("").alias("gradTo"), F.lit("linear").alias("gradKind"), F.lit(0.0).alias("gradAngle"), F.lit("https://x/a.png").alias("bgImage"), F.lit(7.0).alias("bgDim"), F.lit(99.0).alias("bgBlur"))
    got = values(spark, [("x",)], C.background(style))[0]
    assert (got and (got.image, got.color, got.dark)) == want
