"""DuckDB SQL fragments that restate :mod:`pressroom.functions.text` for the oracle.

Each helper takes a SQL expression string and returns one.  The patterns are
the same text as the Spark side (the Java / RE2 common subset); RE2 needs the
``'g'`` option to replace every match and ``\\1`` instead of ``$1``.
"""

from __future__ import annotations

from pressroom.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def nl(s: str) -> str:
    """SQL string literal that may hold newlines / tabs (E'' form avoided: chr())."""
    if "\n" not in s and "\t" not in s:
        return q(s)
    parts = []
    buf = ""
    for ch in s:
        if ch in "\n\t":
            if buf:
                parts.append(q(buf))
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        parts.append(q(buf))
    return "(" + " || ".join(parts) + ")"


def rx_replace(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {q(pat)}, {nl(rep)}, 'g')"


PY_WS_SQL = "(" + " || ".join(f"chr({ord(ch)})" for ch in T.PY_WS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {PY_WS_SQL})"


def strip_char(x: str, ch: str) -> str:
    e = T.lit_regex(ch)
    return rx_replace(x, rf"\A{e}+|{e}+\z", "")


def cdata_unwrap(x: str) -> str:
    return f"regexp_replace({x}, {q(r'(?s)<!\[CDATA\[(.*?)\]\]>')}, '\\1', 'g')"


def clean(x: str) -> str:
    return strip(cdata_unwrap(x))


def tag_text(x: str, tag: str) -> str:
    t = T.lit_regex(tag)
    return clean(f"regexp_extract({x}, {q(rf'(?s)<{t}>(.*?)</{t}>')}, 1)")


def source_text(x: str) -> str:
    return clean(f"regexp_extract({x}, {q(r'(?s)<source[^>]*>(.*?)</source>')}, 1)")


def first_nonempty(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def meta_property(x: str, prop: str) -> str:
    return f"regexp_extract({x}, {q('<meta property=\"' + T.lit_regex(prop) + '\" content=\"([^\"]+)\"')}, 1)"


def title_tag(x: str, cuts=(" - ", " | ")) -> str:
    t = f"regexp_extract({x}, '<title>([^<]+)</title>', 1)"
    for sep in cuts:
        t = f"split_part({t}, {q(sep)}, 1)"
    return strip(t)


def page_date(x: str, with_time_tag: bool = True) -> str:
    pats = [T.DATE_PUBLISHED_META, T.DATE_JSON_LD] + ([T.DATE_TIME_TAG] if with_time_tag else [])
    return "substring(" + first_nonempty(*[f"regexp_extract({x}, {q(p)}, 1)" for p in pats]) + ", 1, 10)"


def rfc822_day(x: str) -> str:
    g = lambda i: f"regexp_extract({x}, {q(T.RFC822)}, {i})"
    months = ", ".join(f"{q(m)}: {i + 1}" for i, m in enumerate(T.EN_MONTHS))
    longs = ", ".join(f"{q(m)}: {i + 1}" for i, m in enumerate(T.EN_MONTHS_LONG) if m != "may")
    mon = f"(MAP {{{months}, {longs}}})[lower({g(2)})]"
    y = f"try_cast({g(3)} AS INTEGER)"
    year = f"(CASE WHEN length({g(3)}) = 2 THEN CASE WHEN {y} > 68 THEN {y} + 1900 ELSE {y} + 2000 END ELSE {y} END)"
    txt = f"printf('%04d-%02d-%02d', {year}, {mon}, try_cast({g(1)} AS INTEGER))"
    ok_time = (f"(try_cast({g(4)} AS INTEGER) <= 23 AND try_cast({g(5)} AS INTEGER) <= 59 "
               f"AND ({g(6)} = '' OR try_cast({g(6)} AS INTEGER) <= 59))")
    day = f"try_strptime({txt}, '%Y-%m-%d')"
    return (f"(CASE WHEN {g(1)} <> '' AND {mon} IS NOT NULL AND {ok_time} AND {day} IS NOT NULL "
            f"THEN strftime({day}, '%Y-%m-%d') ELSE '' END)")


def pt_dotted_month(x: str) -> str:
    g = lambda i: f"regexp_extract({x}, {q(T.PT_DOTTED)}, {i})"
    months = ", ".join(f"{q(m)}: {q(f'{i + 1:02d}')}" for i, m in enumerate(T.PT_MONTHS))
    mm = f"(MAP {{{months}}})[lower({g(2)})]"
    return f"(CASE WHEN {g(1)} <> '' AND {mm} IS NOT NULL THEN {g(3)} || '-' || {mm} ELSE '' END)"


def paragraphs(x: str) -> str:
    ps = f"regexp_extract_all({x}, {q(r'(?s)<p[^>]*>(.+?)</p>')}, 1)"
    cleaned = f"list_transform({ps}, lambda p: {strip(rx_replace('p', '<[^>]+>', ''))})"
    return f"list_filter({cleaned}, lambda p: length(p) > 50)"


def body_slice(ps: str) -> str:
    return f"(CASE WHEN len({ps}) > 5 THEN list_slice({ps}, 2, len({ps}) - 2) ELSE {ps} END)"


def html_to_text(x: str) -> str:
    t = x
    for pat, rep in T.HTML_TEXT_STEPS:
        t = rx_replace(t, pat, rep)
    for ent, ch in T.ENTITIES:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    for pat, rep in T.HTML_TEXT_TIDY:
        t = rx_replace(t, pat, rep)
    return strip(t)


def long_lines(t: str, min_len: int = 30) -> str:
    ls = f"list_transform(string_split({t}, chr(10)), lambda l: {strip('l')})"
    return f"list_filter({ls}, lambda l: length(l) > {min_len})"


def lines_summary(t: str) -> str:
    ls = long_lines(t)
    return (f"(CASE WHEN len({ls}) > 1 THEN substring(array_to_string(list_slice({ls}, 2, 4), ' '), 1, 300) "
            f"WHEN len({ls}) = 1 THEN substring({ls}[1], 1, 300) ELSE '' END)")


def second_chunk(t: str) -> str:
    return (f"substring(CASE WHEN strpos({t}, chr(10) || chr(10)) > 0 "
            f"THEN split_part({t}, chr(10) || chr(10), 2) ELSE {t} END, 1, 300)")


def url_host(x: str, lower: bool = True) -> str:
    h = f"regexp_extract({x}, {q(T.URL_AUTHORITY)}, 1)"
    return f"lower({h})" if lower else h


def url_fetch_clean(x: str) -> str:
    return rx_replace(strip(x), r"/+\z", "")


def url_store_clean(x: str) -> str:
    return strip_char(strip(x), '"')


def query_tokens(x: str, distinct: bool = True) -> str:
    toks = f"list_filter(regexp_extract_all(lower({x}), {q(T.WORD)}, 0), lambda t: length(t) >= 4)"
    if distinct:
        # first-occurrence order, like array_distinct
        return (f"list_filter({toks}, lambda t, i: list_position({toks}, t) = i)")
    return toks


def kw_list(kws) -> str:
    return "[" + ", ".join(q(k) for k in kws) + "]::VARCHAR[]"


def keyword_hits(x_lc: str, kws: str) -> str:
    return f"len(list_filter({kws}, lambda k: contains({x_lc}, k)))"


def any_keyword(x_lc: str, kws: str) -> str:
    return f"({keyword_hits(x_lc, kws)} > 0)"


def slash_count(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '/', '')))"


def paywalled_norm(x: str) -> str:
    inner = f"(CASE WHEN coalesce({x}, '') = '' THEN 'no' ELSE {x} END)"
    return f"lower({strip(inner)})"
