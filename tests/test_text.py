"""Scalar text / date / URL functions on hand-picked values."""

import pytest
from pyspark.sql import functions as F

from pressroom.functions import text as T


def _eval(spark, col_fn, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_rfc822_day(spark):
    got = _eval(spark, T.rfc822_day, [
        "Tue, 05 Mar 2024 10:00:00 +0000",   # usual form
        "5 Mar 2024 23:59 -0300",            # no weekday, no seconds, negative offset: own day kept
        "Wed, 31 Feb 2024 10:00:00 GMT",     # impossible day
        "05 Mar 2024",                       # no time
        "Tue, 05 Foo 2024 10:00:00 +0000",   # unknown month
        "01 january 99 00:00:00",            # long month name, two-digit year
        "01 Jan 68 00:00:00",                # pivot
        "", None, "not a date",
    ])
    assert got == ["2024-03-05", "2024-03-05", "", "", "", "1999-01-01", "2068-01-01", "", "", ""]


def test_pt_dotted_month(spark):
    vals = ["12.mar.2024", "Publicado 3.dez.2023 às 10h", "1.xyz.2020", "sem data", "12.03.2024"]
    assert _eval(spark, T.pt_dotted_month, vals) == ["2024-03", "2023-12", "", "", ""]
    assert _eval(spark, lambda c: T.pt_dotted_month(c, mode="day"), vals) == \
        ["2024-12", "2023-03", "2020-01", "", "2024-12"]


def test_strip_cdata_tags(spark):
    assert _eval(spark, T.py_strip, ["  a b  \n", " x　"]) == ["a b", "x"]
    assert _eval(spark, T.clean, ["<![CDATA[ Olá ]]>", " plain ", "<![CDATA[a]]> and <![CDATA[b]]>"]) == \
        ["Olá", "plain", "a and b"]
    item = "<title>\n<![CDATA[ A, title ]]>\n</title><link>https://x/1</link><source url='s'>Src</source>"
    assert _eval(spark, lambda c: T.tag_text(c, "title"), [item]) == ["A, title"]
    assert _eval(spark, lambda c: T.tag_text(c, "pubDate"), [item]) == [""]
    assert _eval(spark, T.source_text, [item]) == ["Src"]


def test_meta_title_date(spark):
    html = ('<title>Head - Site | Other</title><meta property="og:title" content="OG">'
            '<script>{"datePublished" : "2024-01-02T03:04:05Z"}</script><time datetime="2020-01-01">')
    assert _eval(spark, lambda c: T.meta_property(c, "og:title"), [html, "<meta content='x'>"]) == ["OG", ""]
    assert _eval(spark, lambda c: T.title_tag(c, (" - ", " | ")), [html, "<title>A | B</title>", ""]) == \
        ["Head", "A", ""]
    assert _eval(spark, lambda c: T.title_tag(c, (" - ",)), ["<title>A | B - C</title>"]) == ["A | B"]
    assert _eval(spark, T.page_date, [html, '<time class="x" datetime="2021-02-03T00:00">', ""]) == \
        ["2024-01-02", "2021-02-03", ""]
    assert _eval(spark, lambda c: T.page_date(c, with_time_tag=False), ['<time datetime="2021-02-03">']) == [""]


def test_paragraphs_and_slices(spark):
    long = "y" * 60
    html = "".join(f"<p>{i}{long}</p>" for i in range(7)) + "<path d='x'>" + long + "</p>" + "<p>short</p>"
    ps = _eval(spark, T.paragraphs, [html])[0]
    assert len(ps) == 8            # <path ...> opens a paragraph too (kept as in the reference)
    body = _eval(spark, lambda c: T.body_slice(T.paragraphs(c)), [html])[0]
    assert body == ps[1:-2]
    assert _eval(spark, lambda c: T.body_slice(T.paragraphs(c)), ["".join(f"<p>{long}{i}</p>" for i in range(5))])[0] \
        == [f"{long}{i}" for i in range(5)]


def test_summaries(spark):
    text = "short\n" + "a" * 40 + "\n" + "b" * 35 + "\n  " + "c" * 31 + "  \n" + "d" * 50 + "\n" + "e" * 45
    assert _eval(spark, T.lines_summary, [text])[0] == " ".join(["b" * 35, "c" * 31, "d" * 50])
    assert _eval(spark, T.lines_summary, ["x" * 400])[0] == "x" * 300
    assert _eval(spark, T.lines_summary, ["tiny\nlines"])[0] == ""
    assert _eval(spark, T.second_chunk, ["a\n\nb\n\nc", "one", "a\n\n"]) == ["b", "one", ""]


def test_html_to_text(spark):
    html = ("<html><head><title>T</title></head><body><!-- c --><script>x()</script><nav>Menu</nav>"
            "<p>Hello <b>bold</b> and <i>it</i> &amp;amp; &lt;tag&gt;</p><p>Two<br>lines</p></body></html>")
    assert _eval(spark, T.html_to_text, [html])[0] == "Menu\n\nHello **bold** and _it_ &amp; <tag>\n\nTwo\nlines"


def test_urls(spark):
    urls = ["HTTPS://User@Host.Example:8080/p?q#f", "//cdn.example/x", "mailto:a@b", "https://a b.example/x",
            "no-scheme.example/x"]
    assert _eval(spark, T.url_host, urls) == ["user@host.example:8080", "cdn.example", "", "a b.example", ""]
    assert _eval(spark, lambda c: T.url_host(c, lower=False), urls[:1]) == ["User@Host.Example:8080"]
    assert _eval(spark, T.url_fetch_clean, ["  https://x/a//  ", "https://x"]) == ["https://x/a", "https://x"]
    assert _eval(spark, T.url_store_clean, [' "https://x/a" ', '""']) == ["https://x/a", ""]
    assert _eval(spark, T.url_drop_query, ["https://x/a?b=1?c", "https://x"]) == ["https://x/a", "https://x"]
    assert _eval(spark, T.slash_count, ["https://www.x.com/a/b/"]) == [5]


def test_query_tokens(spark):
    q = ["Operação Faroeste e venda VENDA de sentenças", "a bc de", ""]
    assert _eval(spark, lambda c: T.query_tokens(c, distinct=False), q) == [
        ["operação", "faroeste", "venda", "venda", "sentenças"], [], []]
    assert _eval(spark, T.query_tokens, q)[0] == ["operação", "faroeste", "venda", "sentenças"]


def test_keyword_predicates(spark):
    f = lambda c: F.struct(T.keyword_hits(F.lower(c), ["venda", "juiz", "tj"]).alias("n"),
                           T.min_keyword_match(F.lower(c), ["venda", "juiz", "tj"]).alias("m"),
                           T.min_keyword_match(F.lower(c), ["venda"]).alias("m1"),
                           T.any_keyword(F.lower(c), []).alias("none"))
    got = [tuple(r) for r in _eval(spark, f, ["Venda de decisão por juiz", "venda", "nada"])]
    assert got == [(2, True, True, False), (1, False, True, False), (0, False, False, False)]


@pytest.mark.parametrize("v,exp", [("", "no"), (" YES ", "yes"), ("No", "no"), (None, "no")])
def test_paywalled(spark, v, exp):
    assert _eval(spark, T.paywalled_norm, [v]) == [exp]


def test_row_key_name(spark):
    assert _eval(spark, T.row_key_name, [1, 42, 999, 1234], "long") == ["001", "042", "999", "1234"]
