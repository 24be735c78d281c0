"""Theme lookups and what a merge says."""

from pyspark.sql import functions as F

from foliospark.functions import theme as H
from foliospark.operators.merge import describe_merge


def test_modes_and_palettes(spark):
    rows = spark.createDataFrame([("", "dark", False), ("light", "dark", True), (None, "auto", True), ("", "", False), ("odd", "", True)], "o string, m string, d boolean")
    assert [r[0] for r in rows.select(H.resolve_mode("o", "m", F.col("d"))).collect()] == ["dark", "light", "dark", "light", "light"]
    presets = spark.createDataFrame([("ink", "dark", "a"), ("ink", "light", "b"), ("sea", "dark", "c")], "id string, mode string, palette string")
    themes = spark.createDataFrame([(1, "sea", "dark"), (2, "none", "light"), (3, "sea", "light")], "i int, preset string, mode string")
    assert [r.palette for r in H.with_palette(themes, presets).orderBy("i").collect()] == ["c", "b", "b"]
    assert H.fonts_for(presets.withColumnRenamed("mode", "script"), "dark").count() == 2


def test_variables_and_insets(spark):
    palette = F.struct(*(F.lit(f"#{i}{i}{i}").alias(n) for i, n in enumerate(("bg", "bg2", "surface", "surface2", "border", "text", "dim", "faint", "accent"))))
    theme = F.struct(F.lit("#ffffff").alias("accent"), F.lit(0.0).alias("radius"), F.lit(20.0).alias("baseSize"), F.lit(None).cast("double").alias("headWeight"))
    v = spark.range(1).select(H.page_variables(theme, palette, F.lit("dark"))).first()[0]
    assert (v["--accent"], v["--on-accent"], v["--radius"], v["--radius-sm"], v["--base-size"], v["--head-weight"], v["--accent-soft"]) == ("#ffffff", "#14110D", "18px", "9.9px", "20px", "620", "rgba(255,255,255,0.18)")
    inset = lambda kind: tuple(spark.range(1).select(H.frame_insets(F.lit(kind), F.lit(10.0), F.lit(2.0), F.lit(1.0))).first()[0])
    assert inset("rule") == (3, 0, 3, 12) and inset("double") == (16,) * 4 and inset("none") == (0,) * 4 and inset("quotes") == (56, 10, 10, 10)


def test_describe_merge(spark):
    rows = spark.createDataFrame([(1, 2, ["site"]), (0, 0, []), (0, 1, [])], "k long, u long, s array<string>")
    assert [r[0] for r in rows.select(describe_merge(F.col("k"), F.col("u"), F.col("s"))).collect()] == [
        "kept 1 piece from your live site that this device did not have, took the newer version of 2 pieces edited on another device, kept your live site settings", "",
        "took the newer version of 1 piece edited on another device",
    ]
