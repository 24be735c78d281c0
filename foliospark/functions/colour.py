"""Colours, gradients and the styles made from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import blank_to, col, let, safe_colour, safe_image_url, text, trim


def js_round(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + 0.5)


def number(c: Column | str, default: float | None = None) -> Column:
    """A lenient number, hexadecimal with 0x too; with a default, null, text and 0 become it."""
    t = trim(c)
    hexed = F.conv(F.substring(t, 3, 16), 16, 10).try_cast("double")
    n = F.when(t.rlike("(?i)^0x[0-9a-f]+$"), hexed).otherwise(t.try_cast("double"))
    return n if default is None else F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(float(default)))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def hex_to_rgb(c: Column | str) -> Column:
    """struct<r,g,b> of three or six hex digits; null for anything else."""

    def parts(h: Column) -> Column:
        part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
        return F.when(h.rlike("(?i)^[0-9a-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))

    digits = F.regexp_replace(text(c), "^([^#]*)#", "$1")
    return let(let(digits, lambda h: F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)), parts)


def rgba(c: Column | str, alpha: Column | float) -> Column:
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    zero = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return let(F.coalesce(hex_to_rgb(c), zero), lambda v: F.concat(F.lit("rgba("), F.concat_ws(",", v["r"].cast("string"), v["g"].cast("string"), v["b"].cast("string"), a.cast("string")), F.lit(")")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    two = lambda v: F.lpad(F.lower(F.hex(js_round(v).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def mix(a: Column | str, b: Column | str, ratio: Column | float) -> Column:
    """Between two hex colours; the first as it is where either is none."""
    t = clamp(F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio, 0, 1)

    def mixed(v: Column) -> Column:
        between = lambda k: v["x"][k] + (v["y"][k] - v["x"][k]) * t
        return F.when(v["x"].isNull() | v["y"].isNull(), col(a)).otherwise(to_hex(between("r"), between("g"), between("b")))

    return let(F.struct(hex_to_rgb(a).alias("x"), hex_to_rgb(b).alias("y")), mixed)


def luminance(c: Column | str) -> Column:
    def linear(v: Column) -> Column:
        return F.when(v / 255 <= 0.03928, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4)))

    return let(hex_to_rgb(c), lambda v: 0.2126 * linear(v["r"]) + 0.7152 * linear(v["g"]) + 0.0722 * linear(v["b"]))


def is_light(c: Column | str) -> Column:
    """Whether dark text reads well on it; what is no colour counts as light."""
    return F.coalesce(luminance(c) > 0.45, F.lit(True))


def stops(grad_stops: Column, grad_from: Column | str, grad_to: Column | str) -> Column:
    """array<struct<c,p>> by position: the valid ones of a list if two or more, else a pair."""
    typed = F.transform(F.coalesce(grad_stops, F.array().cast("array<struct<c:string,p:double>>")), lambda s: F.struct(safe_colour(s["c"], "").alias("c"), s["p"].try_cast("double").alias("p")))
    valid = F.filter(typed, lambda s: (s["c"] != "") & (s["c"] != "transparent") & s["p"].isNotNull() & ~F.isnan(s["p"]))
    pair = F.array(
        F.struct(safe_colour(grad_from, "#222222").alias("c"), F.lit(0.0).alias("p")),
        F.struct(safe_colour(grad_to, "#000000").alias("c"), F.lit(100.0).alias("p")),
    )

    def ordered(clean: Column) -> Column:  # equal positions keep their order
        keyed = F.array_sort(F.transform(clean, lambda s, i: F.struct(s["p"].alias("p"), i.alias("i"), s["c"].alias("c"))))
        return F.when(F.size(clean) >= 2, F.transform(keyed, lambda s: F.struct(s["c"].alias("c"), s["p"].alias("p")))).otherwise(pair)

    return let(valid, ordered)


def spread(colours: Column) -> Column:
    n = F.size(colours)
    return F.transform(colours, lambda c, i: F.struct(c.alias("c"), F.when(n == 1, F.lit(0)).otherwise(js_round(i / (n - 1) * 100)).cast("double").alias("p")))


def weights(s: Column) -> Column:
    """For each stop, half the gap to either neighbour (all of it at the ends), 1 at least."""

    def all_of(s: Column) -> Column:
        def weight(x: Column, i: Column) -> Column:
            left = F.when(i > 0, (x["p"] - F.get(s, i - 1)["p"]) / 2).otherwise(x["p"])
            right = F.when(i < F.size(s) - 1, (F.get(s, i + 1)["p"] - x["p"]) / 2).otherwise(100 - x["p"])
            return F.struct(hex_to_rgb(x["c"]).alias("v"), F.greatest(F.lit(1.0), left + right).alias("w"))

        return F.filter(F.transform(s, weight), lambda x: x["v"].isNotNull())

    return let(s, all_of)


def mean_colour(s: Column) -> Column:
    """The weighted mean of a gradient as hex; null without colours."""

    def mean(w: Column) -> Column:
        total = lambda f: F.aggregate(w, F.lit(0.0), lambda acc, x: acc + f(x))
        sums = F.struct(total(lambda x: x["w"]).alias("n"), *(total(lambda x, k=k: x["v"][k] * x["w"]).alias(k) for k in "rgb"))
        return let(sums, lambda t: F.when(t["n"] > 0, to_hex(*(t[k] / t["n"] for k in "rgb"))))

    return let(weights(s), mean)


def gradient_is_dark(s: Column) -> Column:
    return let(mean_colour(s), lambda mean: F.when(mean.isNull(), F.lit(True)).otherwise(~is_light(mean)))


def widest_gap(s: Column) -> Column:
    """Index of the first widest gap between neighbours."""

    def widest(s: Column) -> Column:
        gaps = F.transform(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, i: F.get(s, i + 1)["p"] - x["p"])
        return let(gaps, lambda g: F.array_position(g, F.array_max(g)).cast("int") - 1)

    return let(s, widest)


def _number_text(c: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def gradient_css(s: Column, kind: Column | str, angle: Column | str) -> Column:
    inner = F.array_join(F.transform(s, lambda x: F.concat(x["c"], F.lit(" "), _number_text(x["p"]), F.lit("%"))), ", ")
    a = F.coalesce(col(angle).try_cast("double"), F.lit(160.0))
    return F.when(col(kind) == "radial", F.concat(F.lit("radial-gradient(circle at 50% 45%, "), inner, F.lit(")"))).otherwise(F.concat(F.lit("linear-gradient("), _number_text(a), F.lit("deg, "), inner, F.lit(")")))


def background(style: Column) -> Column:
    """struct<image,color,blur,dark,is_image> of a style; null where the surface is left alone."""
    s = stops(style["gradStops"], style["gradFrom"], style["gradTo"])
    made = lambda image, color, blur, dark, is_image: F.struct(image.alias("image"), color.alias("color"), blur.cast("double").alias("blur"), dark.alias("dark"), is_image.alias("is_image"))
    no, none = F.lit(False), F.lit(0.0)
    solid = safe_colour(style["bgColor"], "#000000")
    source = safe_image_url(style["bgImage"])
    dim = _number_text(clamp(F.coalesce(style["bgDim"].cast("double"), F.lit(0.35)), 0, 1))
    veil = F.concat(F.lit("linear-gradient(rgba(0,0,0,"), dim, F.lit("), rgba(0,0,0,"), dim, F.lit("))"))
    return (
        F.when(style["bgType"] == "solid", made(F.lit("none"), solid, none, ~is_light(solid), no))
        .when(style["bgType"] == "gradient", let(s, lambda g: made(gradient_css(g, style["gradKind"], style["gradAngle"]), F.get(g, F.lit(0))["c"], none, gradient_is_dark(g), no)))
        .when((style["bgType"] == "image") & (source != ""), made(F.concat(veil, F.lit(', url("'), source, F.lit('")')), F.lit("#111111"), clamp(number(style["bgBlur"], 0), 0, 40), F.lit(True), F.lit(True)))
    )


def _css(pairs: list[tuple[str, Column]]) -> Column:
    """Entries whose value is not null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _font(family: Column, lang: Column, fallback: Column) -> Column:
    return F.when(text(family) != "", F.concat(F.lit("'"), family, F.lit("', var(--ff-"), lang, F.lit(")"))).otherwise(fallback)


def text_style(style: Column, lang: Column) -> Column:
    """map of CSS properties of a body; what is as usual is left out."""
    n = lambda k: F.nullif(number(style[k]), F.lit(0.0))
    return _css([
        ("fontFamily", _font(style["font"], lang, F.concat(F.lit("var(--ff-"), lang, F.lit(")")))),
        ("textAlign", F.when((text(style["align"]) != "") & (style["align"] != "left"), style["align"])),
        ("lineHeight", _number_text(n("lineHeight"))),
        ("letterSpacing", F.concat(_number_text(n("letterSpacing")), F.lit("em"))),
        ("fontSize", F.when(n("size") != 1, F.concat(F.lit("calc(var(--base-size) * "), _number_text(n("size")), F.lit(")")))),
        ("fontWeight", F.when(n("weight") != 400, _number_text(n("weight")))),
        ("fontStyle", F.when(style["italic"], "italic")),
        ("textDecoration", F.when(style["underline"], "underline")),
        ("textUnderlineOffset", F.when(style["underline"], "0.22em")),
        ("textDecorationThickness", F.when(style["underline"], "0.06em")),
        ("textShadow", F.when(style["textShadow"], "0 2px 14px rgba(0,0,0,.45)")),
        ("color", F.nullif(safe_colour(style["textColor"], ""), F.lit(""))),
    ])


def title_style(style: Column, lang: Column) -> Column:
    n = lambda k: F.nullif(number(style[k]), F.lit(0.0))
    own = blank_to(text(style["titleFont"]), text(style["font"]))
    align = blank_to(text(style["titleAlign"]), F.when(style["align"] == "justify", F.lit("")).otherwise(text(style["align"])))
    return _css([
        ("fontFamily", _font(own, lang, F.concat(F.lit("var(--fh-"), lang, F.lit(")")))),
        ("fontWeight", F.coalesce(_number_text(n("titleWeight")), F.lit("var(--head-weight)"))),
        ("--title-scale", F.when(n("titleSize") != 1, _number_text(n("titleSize")))),
        ("fontStyle", F.when(style["titleItalic"], "italic")),
        ("textDecoration", F.when(style["titleUnderline"], "underline")),
        ("textUnderlineOffset", F.when(style["titleUnderline"], "0.18em")),
        ("color", F.nullif(safe_colour(style["titleColor"], ""), F.lit(""))),
        ("textAlign", F.when((align != "") & (align != "left"), align)),
    ])


def frame_style(style: Column) -> Column:
    """struct<cls, vars>: the frame's class and its properties, empty without a frame."""
    kind = blank_to(text(style["frame"]), F.lit("none"))
    px = lambda k, default, lo, hi: F.concat(_number_text(clamp(number(style[k], default), lo, hi)), F.lit("px"))
    made = _css([
        ("--fc", blank_to(safe_colour(style["frameColor"], ""), F.lit("var(--accent)"))),
        ("--fw", px("frameWidth", 2, 1, 12)), ("--fr", px("frameRadius", 0, 0, 40)), ("--fp", px("framePad", 0, 0, 64)),
        ("--fs", F.when(style["frameStyle"].isin("solid", "dashed", "dotted", "double"), style["frameStyle"]).otherwise("solid")),
    ])
    return F.when(kind == "none", F.struct(F.lit("").alias("cls"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("vars"))).otherwise(F.struct(F.concat(F.lit("framed frame-"), kind).alias("cls"), made.alias("vars")))


def downscale(width: Column | str, height: Column | str, most: int = 1600) -> Column:
    """struct<width,height> with the longest side at most ``most``, 1 at least."""
    w, h = col(width).cast("double"), col(height).cast("double")
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    side = lambda v: F.greatest(F.lit(1), js_round(v * scale)).cast("long")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def gradient_line(angle: Column | str, width: Column | str, height: Column | str) -> Column:
    """struct<x0,y0,x1,y1>: where a gradient at a CSS angle starts and ends on a canvas."""
    a = F.radians(number(angle, 160))
    w, h = col(width).cast("double"), col(height).cast("double")
    dx, dy = F.sin(a), -F.cos(a)
    half = (F.abs(w * dx) + F.abs(h * dy)) / 2
    return F.struct((w / 2 - dx * half).alias("x0"), (h / 2 - dy * half).alias("y0"), (w / 2 + dx * half).alias("x1"), (h / 2 + dy * half).alias("y1"))


def cover_fit(image_w: Column | str, image_h: Column | str, width: Column | str, height: Column | str) -> Column:
    """struct<x,y,w,h>: an image scaled to cover a box, centred."""
    iw, ih, w, h = (col(c).cast("double") for c in (image_w, image_h, width, height))
    scale = F.greatest(w / iw, h / ih)
    return F.struct(((w - iw * scale) / 2).alias("x"), ((h - ih * scale) / 2).alias("y"), (iw * scale).alias("w"), (ih * scale).alias("h"))
