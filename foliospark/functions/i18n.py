"""Interface strings, languages and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import blank_to, col, text

LANGUAGES = ("gu", "hi", "en")
#: Month names, January first.
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "hi": ("जनवरी", "फ़रवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर", "अक्टूबर", "नवंबर", "दिसंबर"),
    "gu": ("જાન્યુઆરી", "ફેબ્રુઆરી", "માર્ચ", "એપ્રિલ", "મે", "જૂન", "જુલાઈ", "ઑગસ્ટ", "સપ્ટેમ્બર", "ઑક્ટોબર", "નવેમ્બર", "ડિસેમ્બર"),
}


def format_date(iso: Column | str, lang: str = "en") -> Column:
    """Day, month in words, year; what is no date comes back as it is."""
    raw = text(iso)
    d = F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd")
    month = F.element_at(F.array(*(F.lit(m) for m in MONTHS[lang])), F.month(d))
    comma = F.lit(", " if lang == "gu" else " ")
    return F.when(raw == "", "").when(d.isNull(), raw).otherwise(F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), month, comma, F.year(d).cast("string")))


def today(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def iso_now(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def relative_age(now_ms: Column, at_ms: Column) -> Column:
    """Minutes under an hour, hours under a day, then days, halves up."""
    mins = F.greatest(F.lit(1), F.floor((now_ms - F.coalesce(at_ms, F.lit(0))) / 60000 + 0.5))
    part = lambda unit: F.floor(mins / unit + 0.5).cast("string")
    return F.when(mins < 60, F.concat(mins.cast("string"), F.lit(" min ago"))).when(mins < 1440, F.concat(part(60), F.lit(" h ago"))).otherwise(F.concat(part(1440), F.lit(" days ago")))


def is_fresh(now_ms: Column, saved_ms: Column, minutes: int = 15) -> Column:
    return F.coalesce(now_ms - saved_ms < minutes * 60_000, F.lit(False))


def ui_language(saved: Column | str, browser: Column) -> Column:
    """The saved choice if supported, else the first supported browser language, else English."""
    known = F.filter(F.transform(browser, lambda x: F.lower(F.substring(x, 1, 2))), lambda x: x.isin(*LANGUAGES))
    return F.when(col(saved).isin(*LANGUAGES), col(saved)).otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit("en")))


def localised(base: Column | str, by_lang: dict[str, Column | str], lang: Column | str, default: str) -> Column:
    """The value for the language if set, else the base value, else a literal."""
    own = F.lit(None).cast("string")
    for code, c in by_lang.items():
        own = F.when(col(lang) == code, text(c)).otherwise(own)
    return blank_to(F.coalesce(own, F.lit("")), blank_to(text(base), F.lit(default)))


def translate_keys(keys: DataFrame, strings: DataFrame, lang: str, key: str = "key", fallback: str | None = None) -> DataFrame:
    """Adds ``label``: the string in ``lang``, else in English, else the fallback column, else the key.

    strings: lang, key, value, unique by lang and key; an equi-join, whose side Catalyst picks by size.
    """
    both = strings.where(F.col("lang").isin(lang, "en")).groupBy(F.col("key").alias("_k")).agg(F.max(F.when(F.col("lang") == lang, F.col("value"))).alias("_own"), F.max(F.when(F.col("lang") == "en", F.col("value"))).alias("_en"))
    other = F.col(fallback) if fallback else F.lit(None).cast("string")
    return keys.join(both, keys[key] == both["_k"], "left").withColumn("label", F.coalesce("_own", "_en", other, F.col(key))).drop("_k", "_own", "_en")
