"""Per-outlet search over captured bodies -> stubs, and the whole collect over them."""

from pressroom.plans.collect import collect
from pressroom.plans.discover import search_all
from pressroom.sources.outlets import outlets_df, select_outlets

ROWS = [
    ("gn1", "conjur", "rss", 1,
     "<item><title>Venda de sentença</title><link>https://www.conjur.com.br/a</link></item>"
     "<item><title>Fora</title><link>https://other.example/x</link></item>"),
    ("m1", "migalhas", "results", 1,
     '<a href="/quentes/1">Um</a><a href="/outra/2">Dois</a><a href="/depeso/3">Tres</a>'),
    ("m2", "migalhas", "results", 2, '<a href="/quentes/1">Um de novo</a>'),
    ("m3", "migalhas", "results", 3, '<a href="/quentes/9">Nunca lido</a>'),
    ("rss", "estadao", "rss", 1,
     "<item><title><![CDATA[Venda de sentença no tribunal]]></title><link>https://www.estadao.com.br/p/1</link></item>"
     "<item><title><![CDATA[Venda apenas]]></title><link>https://www.estadao.com.br/p/2</link></item>"),
    ("https://oglobo.globo.com/idx", "globo", "sitemap_index", 1,
     "<loc>https://oglobo.globo.com/sitemap/oglobo/2026/01/02_1.xml</loc>"
     "<loc>https://oglobo.globo.com/sitemap/oglobo/2010/01/02_1.xml</loc>"),
    ("https://oglobo.globo.com/sitemap/oglobo/2026/01/02_1.xml", "globo", "sitemap", 1,
     "<loc>https://oglobo.globo.com/venda-de-sentenca</loc><loc>https://oglobo.globo.com/outra</loc>"),
    ("https://oglobo.globo.com/sitemap/oglobo/2010/01/02_1.xml", "globo", "sitemap", 1,
     "<loc>https://oglobo.globo.com/venda-antiga</loc>"),
    ("ps1", "piaui", "sitemap", 1, "<loc> https://piaui.folha.uol.com.br/venda-x </loc>"),
]


def test_search_all(spark):
    feeds = spark.createDataFrame(ROWS, "feed_id string, outlet_key string, kind string, page_no int, xml string")
    stubs, notes = search_all(feeds, "venda de sentença", ["conjur", "migalhas", "estadao", "globo", "folha", "piaui"],
                              max_pages=2, year=2026)
    got = sorted((r.outlet_key, r.url) for r in stubs.collect())
    assert got == [
        ("conjur", "https://www.conjur.com.br/a"),
        ("estadao", "https://www.estadao.com.br/p/1"),
        ("globo", "https://oglobo.globo.com/venda-de-sentenca"),
        ("migalhas", "https://www.migalhas.com.br/depeso/3"),
        ("migalhas", "https://www.migalhas.com.br/quentes/1"),
        ("piaui", "https://piaui.folha.uol.com.br/venda-x "),
    ]
    assert [(r.outlet_key, r.note) for r in notes.collect()] == [("folha", "search failed: nothing captured")]
    # a page that was not captured stops a search, as an empty one does
    gap = feeds.where("feed_id <> 'm2'")
    assert sorted(r.url for r in search_all(gap, "venda de sentença", ["migalhas"], max_pages=3)[0].collect()) == \
        ["https://www.migalhas.com.br/depeso/3", "https://www.migalhas.com.br/quentes/1"]
    # no usable token: no sitemap is searched; wrapped feed links are resolved before the domain filter
    assert search_all(feeds, "a b", ["globo"], max_pages=2)[0].count() == 0
    red = spark.createDataFrame([("https://news.google.com/rss/articles/7", "https://www.conjur.com.br/w")], "from_url string, to_url string")
    wrapped = spark.createDataFrame([("g", "conjur", "rss", 1, "<item><title>t</title><link>https://news.google.com/rss/articles/7</link></item>")], feeds.schema)
    assert [r.url for r in search_all(wrapped, "x", ["conjur"], redirects=red)[0].collect()] == ["https://www.conjur.com.br/w"]
    # the stubs feed collect directly
    pages = spark.createDataFrame([("https://www.conjur.com.br/a", "<p>" + "x" * 400 + "</p>")], "url string, html string")
    store = spark.createDataFrame([], "row_num long, url string")
    res = collect(stubs, pages, select_outlets(outlets_df(spark), "conjur,migalhas"), store, notes=notes,
                  with_dom=False)
    assert [(r.row_num, r.outlet, r.title) for r in res.articles.collect()] == [(1, "Conjur", "Venda de sentença")]


def test_another_outlet_is_a_row(spark):
    """A seventh outlet with two kinds of bodies, by rows alone; an outlet without a row is refused."""
    import pytest

    from pressroom.sources.outlets import SEARCH_ROWS, search_rules_df

    rows = SEARCH_ROWS + [
        ("nova", "results", "link", "", "/n/", "https://nova.example", "nova.example", "url", "", 0, "paged distinct labelled"),
        ("nova", "sitemap", "loc", "<loc>(https://nova[.]example/[^<]+)</loc>", "", "", "", "url", "", 0, "distinct"),
    ]
    feeds = spark.createDataFrame([
        ("a", "nova", "results", 1, "<a href='/n/venda-1'>Um</a><a href='/n/outro'>Dois</a>"),
        ("b", "nova", "results", 3, "<a href='/n/venda-3'>Longe</a>"),
        ("c", "nova", "sitemap", 1, "<loc>https://nova.example/n/venda-1</loc><loc>https://nova.example/n/venda-2</loc>"),
    ], "feed_id string, outlet_key string, kind string, page_no int, xml string")
    stubs, notes = search_all(feeds, "venda", ["nova", "piaui"], max_pages=2, search_rules=search_rules_df(spark, rows))
    got = sorted((r.outlet_key, r.page_no, r.feed, r.url, r.title) for r in stubs.collect())
    assert got == [("nova", 1, "a", "https://nova.example/n/venda-1", "Um"), ("nova", 2, "c", "https://nova.example/n/venda-2", "")]
    assert [r.outlet_key for r in notes.collect()] == ["piaui"]
    with pytest.raises(KeyError):
        search_all(feeds, "venda", ["nova"])
