"""Column -> Column scalars for captured HTML / XML / URL text.

Everything here is a built-in Spark expression (regexp_*, split_part, higher
order functions), so it stays inside whole-stage code generation; no Python
runs per row.  Patterns are written so the same text means the same thing in
Java regex (Spark) and RE2 (the DuckDB oracle): explicit character classes
instead of ``\\w`` / ``\\s``, ``\\A`` / ``\\z`` anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, written out so Java and RE2 agree on it.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
# The same set as characters (derived from Python's own definition), for btrim.
PY_WS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# Python's \w for str: letters, numbers, underscore.
WORD = r"[\p{L}\p{N}_]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_regex(s: str) -> str:
    """Escape a literal for use inside a Java / RE2 pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace off both ends (a character-set
    trim, several times faster than the equivalent regex on long texts)."""
    return F.btrim(_c(c), F.lit(PY_WS))


def strip_char(c, ch: str) -> Column:
    """Python ``str.strip(ch)`` for one character."""
    e = lit_regex(ch)
    return F.regexp_replace(_c(c), rf"\A{e}+|{e}+\z", "")


def cdata_unwrap(c) -> Column:
    return F.regexp_replace(_c(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")


def clean(c) -> Column:
    """CDATA unwrap then strip."""
    return py_strip(cdata_unwrap(c))


def tag_text(item, tag: str) -> Column:
    """Inner text of the first ``<tag>..</tag>`` (CDATA unwrapped, stripped); '' if absent."""
    t = lit_regex(tag)
    return clean(F.regexp_extract(_c(item), rf"(?s)<{t}>(.*?)</{t}>", 1))


def source_text(item) -> Column:
    """Text of the first ``<source ...>..</source>``; '' if absent."""
    return clean(F.regexp_extract(_c(item), r"(?s)<source[^>]*>(.*?)</source>", 1))


def nullif_empty(c) -> Column:
    c = _c(c)
    return F.when(c != "", c)


def first_nonempty(*cols) -> Column:
    """First non-empty string of ``cols``; '' when all are empty."""
    return F.coalesce(*[nullif_empty(c) for c in cols], F.lit(""))


# ---------------------------------------------------------------- meta / title / date

def meta_property(html, prop: str) -> Column:
    """``<meta property="P" content="V"`` exactly, V non-empty; '' when absent."""
    return F.regexp_extract(_c(html), rf'<meta property="{lit_regex(prop)}" content="([^"]+)"', 1)


def title_tag(html, cuts: Iterable[str] = (" - ", " | ")) -> Column:
    """``<title>`` text cut at each separator in turn (literal), stripped."""
    t = F.regexp_extract(_c(html), r"<title>([^<]+)</title>", 1)
    for sep in cuts:
        t = F.split_part(t, F.lit(sep), F.lit(1))
    return py_strip(t)


# Page-date patterns, tried in this order.
DATE_PUBLISHED_META = r'<meta property="article:published_time" content="([^"]+)"'
DATE_JSON_LD = r'"datePublished"[\t\n\x0B\f\r ]*:[\t\n\x0B\f\r ]*"([^"]+)"'
DATE_TIME_TAG = r'<time[^>]*datetime="([^"]+)"'


def page_date(html, with_time_tag: bool = True) -> Column:
    """First of published_time meta, JSON-LD datePublished[, <time datetime>]; 10 chars."""
    pats = [DATE_PUBLISHED_META, DATE_JSON_LD] + ([DATE_TIME_TAG] if with_time_tag else [])
    found = first_nonempty(*[F.regexp_extract(_c(html), p, 1) for p in pats])
    return F.substring(found, 1, 10)


# English month names as RFC 822 dates write them.
EN_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
EN_MONTHS_LONG = ["january", "february", "march", "april", "may", "june", "july", "august",
                  "september", "october", "november", "december"]

RFC822 = (r"\A[\t\n\x0B\f\r ]*(?:[A-Za-z]+,?[\t\n\x0B\f\r ]+)?"
          r"([0-9]{1,2})[\t\n\x0B\f\r ]+([A-Za-z]+)[\t\n\x0B\f\r ]+([0-9]{4}|[0-9]{2})[\t\n\x0B\f\r ]+"
          r"([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?(?:[\t\n\x0B\f\r ]|\z)")


def _month_map() -> Column:
    pairs = []
    for i, m in enumerate(EN_MONTHS):
        pairs += [F.lit(m), F.lit(i + 1)]
    for i, m in enumerate(EN_MONTHS_LONG):
        if m != "may":
            pairs += [F.lit(m), F.lit(i + 1)]
    return F.create_map(*pairs)


def rfc822_day(c) -> Column:
    """RFC 822 date text -> 'YYYY-MM-DD' in the text's own offset; '' when invalid.

    Day, month name (short or long, any case), 2- or 4-digit year and a time
    are required; two-digit years follow the 69/68 pivot.  An impossible
    calendar day or time gives ''.
    """
    # the pattern runs once: its six parts are written side by side, marked, and split again
    parts = F.split(F.regexp_replace(_c(c), r"(?s)" + RFC822 + r".*\z", "\x02$1|$2|$3|$4|$5|$6"), r"\|")

    def day_of(p: Column) -> Column:
        d, mon, y, hh, mi, ss = (F.get(p, i) for i in range(6))
        m = F.element_at(_month_map(), F.lower(mon))
        yi = y.try_cast("int")
        year = (F.when(F.length(y) == 2, F.when(yi > 68, yi + 1900).otherwise(yi + 2000)).otherwise(yi))
        txt = F.format_string("%04d-%02d-%02d", year, m, F.substring(d, 2, 2).try_cast("int"))
        ok_time = ((hh.try_cast("int") <= 23) & (mi.try_cast("int") <= 59)
                   & ((ss == "") | (ss.try_cast("int") <= 59)))
        day = F.try_to_date(txt, "yyyy-MM-dd")
        return F.when(d.startswith("\x02") & m.isNotNull() & ok_time & day.isNotNull(),
                      F.date_format(day, "yyyy-MM-dd")).otherwise(F.lit(""))

    return F.element_at(F.transform(F.array(parts), day_of), 1)


# Portuguese month abbreviations in dotted dates (12.mar.2024).
PT_MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
PT_DOTTED = r"([0-9]{1,2})\.([\p{L}\p{N}_]+)\.([0-9]{4})"


def pt_dotted_month(c, mode: str = "intent") -> Column:
    """'12.mar.2024' -> '2024-03' (documented intent; unknown month -> '').

    ``mode='day'`` reproduces the year-day form some callers depend on
    ('2024-12').
    """
    s = _c(c)
    d = F.regexp_extract(s, PT_DOTTED, 1)
    mon = F.lower(F.regexp_extract(s, PT_DOTTED, 2))
    y = F.regexp_extract(s, PT_DOTTED, 3)
    if mode == "day":
        return F.when(d != "", F.format_string("%s-%02d", y, d.try_cast("int"))).otherwise(F.lit(""))
    pairs = []
    for i, m in enumerate(PT_MONTHS):
        pairs += [F.lit(m), F.lit(f"{i + 1:02d}")]
    mm = F.element_at(F.create_map(*pairs), mon)
    return F.when((d != "") & mm.isNotNull(), F.concat(y, F.lit("-"), mm)).otherwise(F.lit(""))


# ---------------------------------------------------------------- body text

def paragraphs(html) -> Column:
    """All ``<p..>..</p>`` bodies (tags removed, stripped) longer than 50 chars."""
    ps = F.regexp_extract_all(_c(html), F.lit(r"(?s)<p[^>]*>(.+?)</p>"), F.lit(1))
    cleaned = F.transform(ps, lambda p: py_strip(F.regexp_replace(p, r"<[^>]+>", "")))
    return F.filter(cleaned, lambda p: F.length(p) > 50)


def body_slice(ps) -> Column:
    """More than five paragraphs: drop the first and the last two."""
    ps = _c(ps)
    n = F.size(ps)
    return F.when(n > 5, F.slice(ps, F.lit(2), n - 3)).otherwise(ps)


# Entity replacements applied by the text conversion, '&amp;' last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]

# Block-level tags that end a line in readable text.
BLOCK_TAGS = ("p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|aside|"
              "blockquote|main|figure|figcaption|form|dl|dt|dd|pre|title|body|html")

# The conversion, as ordered (pattern, replacement) steps; both engines run the same list.
HTML_TEXT_STEPS = [
    (r"(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " "),
    (r"(?i)<br[^>]*>", "\n"),
    (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n\n"),
    (r"(?i)</?(?:b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(?:em|i)\b[^>]*>", "_"),
    (r"<[^>]*>", ""),
]
HTML_TEXT_TIDY = [
    (r"[\t ]*\n[\t ]*", "\n"),
    (r"\n{3,}", "\n\n"),
]


#: Named references of HTML that end in a semicolon, as one literal: names and what they stand for.
_NAMES = sorted(n[:-1] for n in html5 if n.endswith(";"))


def decode_entities(text) -> Column:
    """Character references decoded once: named ones (with their semicolon), decimal and
    hexadecimal ones; a no-break space becomes a space; anything else stays as it is."""
    t = _c(text)
    words = F.lit("\x01".join(_NAMES))
    stand = F.lit("\x01".join(html5[n + ";"] for n in _NAMES))
    table = F.map_from_arrays(F.split(words, "\x01"), F.split(stand, "\x01"))

    def part(x: Column) -> Column:
        name = F.regexp_extract(x, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.substring(name, 2, 10)
        number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 10), 16, 10)).otherwise(digits).cast("long")
        low = number - 0x10000
        units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(F.concat(
            F.hex(F.shiftright(low, 10) + 0xD800), F.hex(low.bitwiseAND(0x3FF) + 0xDC00)))
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(valid, F.decode(F.unhex(units), "UTF-16BE"))).when(
            name != "", F.try_element_at(table, name))
        return F.coalesce(F.concat(F.replace(char, F.lit("\u00a0"), F.lit(" ")), F.substr(x, F.length(name) + 2)), F.concat(F.lit("&"), x))

    pieces = F.split(t, "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), part)
    return F.when(F.contains(t, F.lit("&")), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(t)


def html_to_text(html) -> Column:
    """Readable text of an HTML page: no head/script/style/comments, blocks on
    their own lines, bold as ``**``, italics as ``_``, tags removed, character
    references decoded, runs of blank lines collapsed, stripped."""
    t = _c(html)
    for pat, rep in HTML_TEXT_STEPS:
        t = F.regexp_replace(t, pat, rep)
    t = decode_entities(t)
    for pat, rep in HTML_TEXT_TIDY:
        t = F.regexp_replace(t, pat, rep)
    return py_strip(t)


def long_lines(text, min_len: int = 30) -> Column:
    """Stripped lines longer than ``min_len``."""
    ls = F.transform(F.split(_c(text), "\n"), lambda x: py_strip(x))
    return F.filter(ls, lambda x: F.length(x) > min_len)


def lines_summary(text) -> Column:
    """2nd-4th long line joined by spaces, or the only long line, cut to 300."""
    ls = long_lines(text)
    n = F.size(ls)
    return (F.when(n > 1, F.substring(F.array_join(F.slice(ls, 2, 3), " "), 1, 300))
            .when(n == 1, F.substring(F.element_at(ls, 1), 1, 300))
            .otherwise(F.lit("")))


def second_chunk(text) -> Column:
    """The second blank-line-separated chunk when there is one, else the text; cut to 300."""
    t = _c(text)
    return F.substring(F.when(F.instr(t, "\n\n") > 0, F.split_part(t, F.lit("\n\n"), F.lit(2))).otherwise(t), 1, 300)


# ---------------------------------------------------------------- URLs

URL_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def url_host(url, lower: bool = True) -> Column:
    h = F.regexp_extract(_c(url), URL_AUTHORITY, 1)
    return F.lower(h) if lower else h


def url_fetch_clean(url) -> Column:
    """Strip blanks, then trailing slashes."""
    return F.regexp_replace(py_strip(url), r"/+\z", "")


def url_drop_query(url) -> Column:
    return F.split_part(_c(url), F.lit("?"), F.lit(1))


def url_absolute(url, base: str) -> Column:
    u = _c(url)
    return F.when(u.startswith("/"), F.concat(F.lit(base), u)).otherwise(u)


def url_store_clean(url) -> Column:
    """Store key: blanks stripped, then double quotes stripped."""
    return strip_char(py_strip(url), '"')


def slash_count(url) -> Column:
    u = _c(url)
    return F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))


# ---------------------------------------------------------------- keywords

def query_tokens(q, distinct: bool = True) -> Column:
    """Lower-cased word runs of length >= 4.  ``distinct=False`` keeps repeats."""
    toks = F.filter(F.regexp_extract_all(F.lower(_c(q)), F.lit(WORD), F.lit(0)), lambda t: F.length(t) >= 4)
    return F.array_distinct(toks) if distinct else toks


def any_keyword(text_lc, kws) -> Column:
    """Some keyword is a substring of the (already lower-cased) text.

    A literal list becomes one OR of ``contains`` (code-generated, literal
    patterns); a keyword array column goes through ``exists``."""
    t = _c(text_lc)
    if not isinstance(kws, Column):
        return contains_any(t, kws)
    return F.exists(kws, lambda k: F.contains(t, k))


def keyword_hits(text_lc, kws) -> Column:
    """Number of listed keywords present at least once (a repeated keyword counts twice)."""
    t = _c(text_lc)
    if not isinstance(kws, Column):
        n = F.lit(0)
        for k in kws:
            n = n + F.contains(t, F.lit(k)).cast("int")
        return n
    return F.size(F.filter(kws, lambda k: F.contains(t, k)))


def min_keyword_match(text_lc, kws) -> Column:
    """At least min(2, #keywords) (and at least one) keywords present."""
    if not isinstance(kws, Column):
        return keyword_hits(text_lc, kws) >= max(1, min(2, len(kws)))
    need = F.greatest(F.lit(1), F.least(F.lit(2), F.size(kws)))
    return keyword_hits(text_lc, kws) >= need


def contains_any(c, parts: Iterable[str]) -> Column:
    c = _c(c)
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def paywalled_norm(c) -> Column:
    """Blank -> 'no', stripped, lower-cased."""
    c = F.coalesce(_c(c), F.lit(""))
    return F.lower(py_strip(F.when(c == "", F.lit("no")).otherwise(c)))


def row_key_name(n) -> Column:
    """Zero-padded to at least three digits (1234 stays 1234)."""
    return F.format_string("%03d", _c(n))
