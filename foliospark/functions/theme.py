"""Theme lookups: mode, preset palettes, page variables, and the layout of a picture of an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.colour import _css, _number_text, background, clamp, is_light, number, rgba
from foliospark.functions.text import blank_to, col, safe_colour, safe_image_url, text


def resolve_mode(override: Column | str, theme_mode: Column | str, prefers_dark: Column) -> Column:
    """light or dark: the reader's choice, else the site's; auto follows the system."""
    mode = blank_to(text(override), blank_to(text(theme_mode), F.lit("auto")))
    return F.when(mode == "auto", F.when(prefers_dark, "dark").otherwise("light")).otherwise(F.when(mode == "dark", "dark").otherwise("light"))


def with_palette(themes: DataFrame, presets: DataFrame, default: str = "ink") -> DataFrame:
    """Adds ``palette`` to themes (preset, mode); presets: id, mode, palette. An unknown preset is the default one.

    A lookup in a table with a row for each preset and mode; the join is Catalyst's to choose.
    """
    named = presets.select(F.col("id").alias("_id"), F.col("mode").alias("_mode"), F.col("palette").alias("_palette"))
    other = presets.where(F.col("id") == default).select(F.col("mode").alias("_default_mode"), F.col("palette").alias("_default"))
    out = themes.join(named, (F.col("preset") == F.col("_id")) & (F.col("mode") == F.col("_mode")), "left").join(other, F.col("mode") == F.col("_default_mode"), "left")
    return out.withColumn("palette", F.coalesce("_palette", "_default")).drop("_id", "_mode", "_palette", "_default_mode", "_default")


def page_variables(theme: Column, palette: Column, mode: Column) -> Column:
    """map of a page's properties; palette: struct<bg,bg2,surface,surface2,border,text,dim,faint,accent>."""
    accent = safe_colour(theme["accent"], palette["accent"])
    dark = mode == "dark"
    radius = number(theme["radius"], 18)
    soft, line = F.when(dark, F.lit(0.18)).otherwise(0.12), F.when(dark, F.lit(0.4)).otherwise(0.3)
    return _css([
        ("--bg", palette["bg"]), ("--bg-2", palette["bg2"]), ("--surface", palette["surface"]), ("--surface-2", palette["surface2"]), ("--border", palette["border"]),
        ("--text", palette["text"]), ("--text-dim", palette["dim"]), ("--text-faint", palette["faint"]), ("--accent", accent),
        ("--accent-soft", rgba(accent, soft)), ("--accent-line", rgba(accent, line)), ("--on-accent", F.when(is_light(accent), "#14110D").otherwise("#FFFFFF")),
        ("--radius", F.concat(_number_text(radius), F.lit("px"))), ("--radius-sm", F.concat(_number_text(F.greatest(F.lit(6.0), radius * 0.55)), F.lit("px"))),
        ("--base-size", F.concat(_number_text(number(theme["baseSize"], 17)), F.lit("px"))), ("--head-weight", _number_text(number(theme["headWeight"], 620))),
    ])


def font_stack(font: Column | str, stack: Column | str, script: Column | str, system: dict[str, str]) -> Column:
    """A font-family value: the face and its fallbacks; of no known face (stack null) the script's system fonts; system has '' for other scripts."""
    other = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in system.items() for x in pair)), col(script)), F.lit(system[""]))
    return F.coalesce(F.concat(F.lit('"'), col(font), F.lit('", '), col(stack)), other)


def page_attributes(theme: Column, preset: Column | str, mode: Column | str) -> Column:
    """map of the attributes by which a page's style rules tell themes apart."""
    return _css([("data-mode", col(mode)), ("data-preset", col(preset)), ("data-card", blank_to(text(theme["cardStyle"]), F.lit("paper"))), ("data-density", blank_to(text(theme["density"]), F.lit("comfortable")))])


def fonts_for(fonts: DataFrame, script: str) -> DataFrame:
    return fonts.where(F.col("script") == script)


def picture_style(style: Column, palette: Column, accent: Column | str) -> Column:
    """struct<kind,image,dim,color,fg,accent> of a picture: the entry's own background, else the theme's surface."""
    own = background(style)
    chosen = F.nullif(safe_colour(style["textColor"], ""), F.lit(""))
    fg = F.coalesce(chosen, F.when(own.isNull(), palette["text"]).when(own["dark"], "#FFFFFF").otherwise("#14110D"))
    return F.struct(
        F.when(own.isNull(), "gradient").when(own["is_image"], "image").otherwise(style["bgType"]).alias("kind"),
        F.when(own.isNotNull(), safe_image_url(style["bgImage"])).otherwise("").alias("image"),
        F.when(own.isNotNull(), number(style["bgDim"], 0)).otherwise(0.0).alias("dim"),
        F.coalesce(own["color"], palette["surface"]).alias("color"), fg.alias("fg"), safe_colour(accent, palette["accent"]).alias("accent"),
    )


def frame_insets(kind: Column | str, pad: Column, width: Column, k: Column) -> Column:
    """struct<t,r,b,l>: what a frame takes of each side, in pixels; k: scale of the canvas."""
    none = F.lit(0.0)
    sides = {
        "rule": (pad * 0.3, none, pad * 0.3, pad + width), "double": (pad + width * 3,) * 4, "stamp": (pad + k * 8,) * 4, "ornament": (pad + k * 34, pad, pad + k * 34, pad),
        "lines": (pad * 0.5, pad, pad * 0.5, pad + k * 6), "quotes": (pad + k * 46, pad, pad, pad), "box": (pad,) * 4, "card": (pad,) * 4, "corners": (pad,) * 4,
    }
    out = F.struct(*(none.alias(s) for s in "trbl"))
    for name, values in sides.items():
        out = F.when(col(kind) == name, F.struct(*(v.cast("double").alias(s) for s, v in zip("trbl", values, strict=True)))).otherwise(out)
    return out


def body_size(width: Column, size: Column) -> Column:
    """The type size with which fitting begins: a share of the width, by the style's size."""
    return width * 0.048 * clamp(size, 0.6, 2)
