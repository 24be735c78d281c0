"""Text functions over columns: white space, inline markup, script detection, escaping, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of browsers' trim() and \\s, for Java patterns.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_WS = WS.replace("[", "[^", 1)
#: Pairs of noncharacters that stand for an opening and a closing marker, in the order in which markers are claimed.
MARKERS = (("**", "﷐", "﷑", "b"), ("__", "﷒", "﷓", "u"), ("*", "﷔", "﷕", "i"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def text(c: Column | str) -> Column:
    """A null is an empty text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def blank_to(c: Column, other: Column) -> Column:
    """``other`` where the text is null or empty."""
    return F.coalesce(F.when(c != "", c), other)


def trim(c: Column | str) -> Column:
    return F.regexp_replace(text(c), f"^{WS}+|{WS}+$", "")


def fold_space(c: Column | str) -> Column:
    return F.regexp_replace(text(c), f"{WS}+", " ")


def marked(c: Column | str) -> Column:
    """The text with paired markers as noncharacters; single markers and empty pairs stay as they are."""
    out = text(c)
    for token, opened, closed, _ in MARKERS:
        quoted = "".join("\\" + x if x == "*" else x for x in token)
        out = F.regexp_replace(out, f"{quoted}([^\\n]*?){quoted}", f"{opened}$1{closed}")
        out = F.replace(out, F.lit(opened + closed), F.lit(token + token))
    return out


def plain(c: Column | str) -> Column:
    """The text without its paired markers."""
    return F.translate(marked(c), "".join(o + x for _, o, x, _ in MARKERS), "")


def has_markup(c: Column | str) -> Column:
    return plain(c) != text(c)


def runs(c: Column | str) -> Column:
    """array<struct<t,b,i,u>>: stretches of one formatting; line breaks are runs of their own."""
    ends = "".join(o + x for _, o, x, _ in MARKERS)
    run = "struct<t:string,b:boolean,i:boolean,u:boolean>"
    off = {f: F.lit(False).alias(f) for f in "biu"}
    start = F.struct(*off.values(), F.array().cast(f"array<{run}>").alias("out"))

    def step(state: Column, token: Column) -> Column:
        flag = {f: F.when(token.isin(o, x), ~state[f]).otherwise(state[f]) for _, o, x, f in MARKERS}
        is_marker = token.isin(*ends)
        now = F.struct(token.alias("t"), state["b"].alias("b"), state["i"].alias("i"), state["u"].alias("u")).cast(run)
        return F.struct(flag["b"].alias("b"), flag["i"].alias("i"), flag["u"].alias("u"), F.when(is_marker, state["out"]).otherwise(F.array_append(state["out"], now)).alias("out"))

    def of_line(line: Column, at: Column) -> Column:  # pairs never cross a line, so each begins without formatting
        tokens = F.regexp_extract_all(line, F.lit(f"([{ends}]|[^{ends}]+)"), F.lit(1))
        broken = F.array(F.struct(F.lit("\n").alias("t"), *off.values()).cast(run))
        return F.concat(F.when(at > 0, broken).otherwise(F.array().cast(f"array<{run}>")), F.aggregate(tokens, start, step, lambda s: s["out"]))

    return F.flatten(F.transform(F.split(marked(c), "\n"), of_line))


def escape_html(c: Column | str) -> Column:
    out = text(c)
    for plain_char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain_char), F.lit(entity))
    return out


def escape_css(c: Column | str) -> Column:
    return F.translate(text(c), "\"'\\<>();", "")


def html(c: Column | str) -> Column:
    """Each run escaped, in <u> within <em> within <strong>."""

    def one(r: Column) -> Column:
        out = escape_html(r["t"])
        for flag, tag in (("u", "u"), ("i", "em"), ("b", "strong")):
            out = F.when(r[flag], F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
        return out

    return F.array_join(F.transform(runs(c), one), "")


def tokens(c: Column | str) -> Column:
    """array<struct<t,b,i,u>>: runs cut into words and the white space between them."""

    def cut(r: Column) -> Column:
        parts = F.regexp_extract_all(r["t"], F.lit(f"({WS}+|{NOT_WS}+)"), F.lit(1))
        return F.transform(parts, lambda t: F.struct(t.alias("t"), r["b"].alias("b"), r["i"].alias("i"), r["u"].alias("u")))

    return F.flatten(F.transform(runs(c), cut))


def script_counts(c: Column | str) -> Column:
    """struct<gu,hi,latin>: characters of the Gujarati and Devanagari blocks, and Latin letters."""
    count = lambda p: F.regexp_count(text(c), F.lit(p)).cast("long")
    return F.struct(count(r"[઀-૿]").alias("gu"), count(r"[ऀ-ॿ]").alias("hi"), count("[A-Za-z]").alias("latin"))


def detect_lang(c: Column | str) -> Column:
    """The script that dominates with more than three characters, else English."""
    n = script_counts(c)
    return F.when((n["gu"] > n["hi"]) & (n["gu"] > 3), "gu").when((n["hi"] > n["gu"]) & (n["hi"] > 3), "hi").otherwise("en")


def auto_lang(c: Column | str, current: Column | str) -> Column:
    """The language to switch to while typing: English only on 12 Latin letters or more, otherwise as it was."""
    found, n = detect_lang(c), script_counts(c)
    return F.when((found == "en") & (n["latin"] < 12), col(current)).otherwise(found)


def safe_url(c: Column | str) -> Column:
    """Images as data, http(s) and paths within the site; anything else is empty."""
    v = trim(c)
    inline = v.rlike(r"(?i)^data:image/(png|jpe?g|gif|webp|avif|svg\+xml);base64,")
    ok = inline | v.rlike(r"(?i)^https?://") | (v.rlike(r"^\.{0,2}/") & ~v.startswith("//"))
    return F.when(~v.rlike(r"[\"'<>\\]|" + WS) & ok, v).otherwise("")


def safe_image_url(c: Column | str) -> Column:
    v = trim(c)
    ok = v.rlike(r"(?i)^data:image/(png|jpe?g|gif|webp|avif);base64,[A-Za-z0-9+/=]+$") | v.rlike(r"(?i)^https://.+$") | (v.rlike(r"^\.{0,2}/") & ~v.startswith("//"))
    return F.when(~v.rlike(r"[\"'()\\]|" + WS) & ok, v).otherwise("")


def safe_colour(c: Column | str, fallback: Column | str | None = None) -> Column:
    """A hex, rgb(), hsl() or named colour; else the fallback exactly as given, 'transparent' without one."""
    v = trim(c)
    other = F.lit("transparent") if fallback is None else F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(v.rlike(r"(?i)^(#[0-9a-f]{3,8}|rgba?\([\d.,%\s/]+\)|hsla?\([\d.,%\sdegra/]+\)|[a-z]{3,20})$"), v).otherwise(other)


def type_label(c: Column | str) -> Column:
    return F.when(col(c) == "poem", "Poem").when(col(c) == "blog", "Blog").when(col(c) == "quote", "Quote").otherwise("")


def safe_filename(title: Column | str, kind: Column | str, date: Column | str) -> Column:
    name = blank_to(text(title), blank_to(type_label(kind), F.lit("writing")))
    name = F.regexp_replace(name, r'[\\/:*?"<>|]+', "")
    name = F.substring(F.regexp_replace(name, f"{WS}+", "-"), 1, 60)
    return F.concat(blank_to(name, F.lit("writing")), F.lit("-"), text(date))


def entry_url(base: str, entry_id: Column | str) -> Column:
    return F.concat(F.lit(f"{base}#/e/"), col(entry_id))


def encode_component(c: Column | str) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() alone."""
    out = F.replace(F.url_encode(text(c)), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def to_base64(c: Column | str) -> Column:
    return F.replace(F.replace(F.base64(F.encode(text(c), "UTF-8")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))


def from_base64(c: Column | str) -> Column:
    return F.decode(F.unbase64(F.regexp_replace(text(c), r"\s", "")), "UTF-8")


def words(c: Column | str) -> Column:
    """Words between white space, markers included."""
    return let(trim(c), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{WS}+")))).cast("long")


def minutes(words_: Column) -> Column:
    """Reading time at 180 words a minute, one at least, halves rounded up."""
    return F.greatest(F.lit(1), F.floor(words_ / 180 + 0.5)).cast("long")


def line_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(text(c), "\n"), lambda x: trim(x) != "")).cast("long")


def preview(kind: Column | str, body: Column | str, excerpt: Column | str, lines: int = 6) -> Column:
    """The excerpt; 240 characters of prose; else the first lines."""
    n = lines or 6

    def prose(flat: Column) -> Column:
        return F.when(F.length(flat) > 240, F.concat(trim(F.substring(flat, 1, 240)), F.lit("…"))).otherwise(flat)

    def verse(rows: Column) -> Column:
        return F.concat(F.array_join(F.slice(rows, 1, n), "\n"), F.when(F.size(rows) > n, "\n…").otherwise(""))

    short = F.when(col(kind) == "blog", let(fold_space(plain(trim(body))), prose)).otherwise(let(F.split(trim(body), "\n"), verse))
    return blank_to(text(excerpt), short)


def label(title: Column | str, kind: Column | str, body: Column | str, most: int = 60) -> Column:
    """The title, else the first line without markup, cut."""
    return let(text(title), lambda t: F.when(t != "", t).otherwise(F.substring(fold_space(plain(preview(kind, body, F.lit(""), 1))), 1, most)))


def as_text(title: Column | str, body: Column | str, credit: Column | str, who: Column | str | None = None, url: Column | None = None) -> Column:
    """An entry to copy: title, plain body, credit, and optionally who wrote it and where it is."""
    full = lambda c, v: F.when(text(c) != "", v)
    parts = [full(title, F.concat(text(title), F.lit("\n"))), plain(trim(body)), full(credit, F.concat(F.lit("\n"), text(credit)))]
    if who is not None:
        parts.append(full(who, F.concat(F.lit("\n— "), text(who))))
        if url is not None:
            parts.append(url)
    return F.concat_ws("\n", *parts)


def export_block(title: Column | str, kind: Column | str, lang: Column | str, date: Column | str, body: Column | str, credit: Column | str) -> Column:
    """An entry in the export of everything; markers stay."""
    name = type_label(kind)
    head = F.concat(F.lit("── "), blank_to(text(title), name), F.lit(" ──"))
    note = F.when(text(credit) != "", F.concat(F.lit("\n"), text(credit))).otherwise("")
    return F.concat_ws("\n", head, F.concat(name, F.lit(" · "), F.upper(text(lang)), F.lit(" · "), text(date)), F.lit(""), trim(body), note)


def clean_lines(c: Column | str) -> Column:
    return F.replace(text(c), F.lit("\r\n"), F.lit("\n"))


def title_of_file(name: Column | str) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(text(name), r"(?i)\.txt$", ""), "[-_]+", " "))


def kind_of_body(body: Column | str) -> Column:
    return F.when(F.size(F.split(text(body), "\n")) > 14, "blog").otherwise("poem")


def uid(prefix: str, *parts: Column | str) -> Column:
    """A surrogate id that is the same whenever it is computed."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(text(p) for p in parts)), 256), 1, 12))


def feedback_body(fields: Column, site_name: str) -> Column:
    """fields: struct<name,email,about,message>."""
    line = lambda k, name: F.when(text(fields[k]) != "", F.concat(F.lit(name), fields[k]))
    head = F.concat_ws("\n", line("about", "About: "), line("name", "From: "), line("email", "Reply to: "))
    return F.concat_ws("\n", F.when(head != "", F.concat(head, F.lit("\n"))), text(fields["message"]), F.lit(""), F.lit(f"— sent from {site_name}"))


def feedback_subject(fields: Column, site_name: str) -> Column:
    return F.concat(F.lit(f"Feedback on {site_name}"), F.when(text(fields["about"]) != "", F.concat(F.lit(" — "), fields["about"])).otherwise(""))


def mailto(fields: Column, site_name: str, address: str) -> Column:
    return F.concat(F.lit("mailto:"), encode_component(F.lit(address)), F.lit("?subject="), encode_component(feedback_subject(fields, site_name)), F.lit("&body="), encode_component(feedback_body(fields, site_name)))


def feedback_payload(fields: Column, site_name: str, page: str) -> Column:
    return F.struct(
        blank_to(text(fields["name"]), F.lit("Anonymous")).alias("name"), text(fields["email"]).alias("email"), feedback_subject(fields, site_name).alias("subject"),
        feedback_body(fields, site_name).alias("message"), text(fields["about"]).alias("about"), F.lit(site_name).alias("site"), F.lit(page).alias("page"),
    )


def reachable(enabled: Column, endpoint: Column | str, email: Column | str) -> Column:
    return F.coalesce(enabled, F.lit(False)) & ((trim(endpoint) != "") | (trim(email) != ""))


def route(path: Column | str) -> Column:
    """struct<view,id> of a fragment path."""
    p = blank_to(text(path), F.lit("/"))
    view = F.when(p.startswith("/e/"), "entry").when(p.startswith("/c/"), "collection").when(p.isin("/feedback", "/about", "/admin"), F.substring(p, 2, 20)).otherwise("home")
    return F.struct(view.alias("view"), F.when(p.startswith("/e/") | p.startswith("/c/"), F.substr(p, F.lit(4))).otherwise("").alias("id"))


def publish_target(url: Column | str) -> Column:
    """struct<owner,repo,path> that a page's address stands for: the host names the owner, the first folder the repository; all '' for other hosts."""

    def target(u: Column) -> Column:
        folders = F.filter(F.split(F.regexp_replace(u["path"], r"/[^/]*\.html?$", "/"), "/"), lambda x: x != "")
        below = F.concat_ws("/", F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(0))), F.lit("data/content.json"))
        made = F.struct(u["owner"].alias("owner"), F.coalesce(F.get(folders, F.lit(0)), u["host"]).alias("repo"), below.alias("path"))
        return F.when(u["owner"] != "", made).otherwise(F.struct(*(F.lit("").alias(k) for k in ("owner", "repo", "path"))))

    host = F.coalesce(F.try_parse_url(text(url), F.lit("HOST")), F.lit(""))
    path = F.coalesce(F.try_parse_url(text(url), F.lit("PATH")), F.lit(""))
    return let(F.struct(host.alias("host"), path.alias("path"), F.regexp_extract(host, r"(?i)^([\w-]+)\.github\.io$", 1).alias("owner")), target)


def error_text(status: Column | str, message: Column | str, texts: dict[str, str]) -> Column:
    """What to tell an author when a request fails, by the caller's texts.

    texts: by status, '403 rate' for a rate limit; {said} stands for the message. Else the message, or the status.
    """
    s = col(status).cast("string")
    said = blank_to(text(message), F.concat(F.lit("HTTP "), s))
    key = F.when((s == "403") & said.rlike("(?i)rate limit"), "403 rate").otherwise(s)
    known = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))
    return F.coalesce(F.replace(F.try_element_at(known, key), F.lit("{said}"), said), said)


def full_links(links: Column) -> Column:
    """The links that have both an address and a label."""
    return F.filter(links, lambda x: (text(x["url"]) != "") & (text(x["label"]) != ""))


def every_wrapped(c: Column | str, token: str) -> Column:
    """Whether every line stands between two of the markers."""
    least = 2 * len(token) + 1
    return F.forall(F.split(text(c), "\n"), lambda x: (F.length(x) >= least) & x.startswith(token) & x.endswith(token))
