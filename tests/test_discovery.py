"""Feeds, sitemaps, link lists, URL lists, redirects, first-seen and page stop."""

from pressroom.operators.discovery import first_seen, stop_at_empty
from pressroom.sources.feeds import (
    resolve_redirects, rss_items, rss_strict, sitemap_index, sitemap_urls, topic_links, url_lines,
    SITEMAP_ANY_RX,
)


def _feed(spark, xml, key="f1"):
    return spark.createDataFrame([(key, xml)], "feed_id string, xml string")


FEED = ("<rss><channel>"
        "<item><title><![CDATA[ First, cdata ]]></title><link>https://x/1</link>"
        "<pubDate>Tue, 05 Mar 2024 23:30:00 -0300</pubDate><source url='u'>Src One</source></item>"
        "<item><title>No link</title></item>"
        "<item><title>Multi\nline</title><link> https://x/3 </link><pubDate>bad</pubDate></item>"
        + "".join(f"<item><title>t{i}</title><link>https://x/n{i}</link></item>" for i in range(30))
        + "</channel></rss>")


def test_rss_items(spark):
    rows = rss_items(_feed(spark, FEED), max_items=25, site="site.example").orderBy("item_pos").collect()
    assert len(rows) == 24                       # 25 taken, then the linkless one dropped
    r = rows[0]
    assert (r.item_pos, r.title, r.url, r.date, r.source) == (1, "First, cdata", "https://x/1", "2024-03-05", "Src One")
    r = rows[1]
    assert (r.item_pos, r.title, r.url, r.date, r.source) == (3, "Multi\nline", "https://x/3", "", "site.example")


def test_rss_strict(spark):
    xml = ("<item><title><![CDATA[Venda de sentença no TJ]]></title><link>https://e/politica/1</link></item>"
           "<item><title>Venda de sentença</title><link>https://e/politica/2</link></item>"
           "<item><title><![CDATA[Venda de sentença]]></title><link>http://e/3</link></item>"
           "<item><title><![CDATA[Venda de sentença]]></title><link>https://e/pulsa/4</link></item>"
           "<item><title><![CDATA[Só venda]]></title><link>https://e/5</link></item>")
    got = [r.url for r in rss_strict(_feed(spark, xml), ["venda", "sentença"]).collect()]
    assert got == ["https://e/politica/1"]
    got1 = sorted(r.url for r in rss_strict(_feed(spark, xml), ["venda"]).collect())
    assert got1 == ["https://e/5", "https://e/politica/1"]


def test_sitemaps(spark):
    idx = ("<loc>https://oglobo.globo.com/sitemap/oglobo/2013/01/02_1.xml</loc>"
           "<loc>https://oglobo.globo.com/sitemap/oglobo/2020/05/06_2.xml</loc>"
           "<loc>https://other.example/sitemap/oglobo/2020/05/06_2.xml</loc>")
    got = [(r.year, r.loc) for r in sitemap_index(_feed(spark, idx), year_from=2014, year_to=2026).collect()]
    assert got == [(2020, "https://oglobo.globo.com/sitemap/oglobo/2020/05/06_2.xml")]
    sm = ("<loc>  https://piaui.example/a-venda  </loc><loc>https://oglobo.globo.com/b-venda</loc>"
          "<loc>https://oglobo.globo.com/c</loc><loc>ftp://x/venda</loc>")
    host = [r.url for r in sitemap_urls(_feed(spark, sm), keywords=["venda"]).collect()]
    assert host == ["https://oglobo.globo.com/b-venda"]
    anyh = [r.url for r in sitemap_urls(_feed(spark, sm), pattern=SITEMAP_ANY_RX, keywords=["venda"]).collect()]
    assert anyh == ["https://piaui.example/a-venda  ", "https://oglobo.globo.com/b-venda"]


def test_topic_links(spark):
    html = ('<a href="https://www.estadao.com.br/politica/x/venda-1/">a</a>'
            '<a href="https://www.estadao.com.br/politica/venda-2">b</a>'
            '<a href="https://www.estadao.com.br/esportes/x/venda-3/">c</a>'
            '<a href="https://www.estadao.com.br/politica/x/venda-1/">dup</a>')
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r.url for r in topic_links(df, keywords=["venda"]).collect()] == \
        ["https://www.estadao.com.br/politica/x/venda-1/"]


def test_url_lines(spark):
    content = "https://a/1/\n\n# comment\n  # indented\n  https://b/2  \n"
    df = spark.createDataFrame([("f", content)], "file string, value string")
    got = [(r.line_no, r.url) for r in url_lines(df).orderBy("line_no").collect()]
    assert got == [(1, "https://a/1/"), (4, "# indented"), (5, "https://b/2")]


def test_redirects(spark):
    stubs = spark.createDataFrame([("https://news.google.com/rss/articles/1",), ("https://news.google.com/rss/articles/9",),
                                   ("https://plain/x",)], "url string")
    red = spark.createDataFrame([("https://news.google.com/rss/articles/1", "https://real/1"),
                                 ("https://plain/x", "https://never")], "from_url string, to_url string")
    assert sorted(r.url for r in resolve_redirects(stubs, red).collect()) == \
        ["https://news.google.com/rss/articles/9", "https://plain/x", "https://real/1"]


def test_first_seen_and_stop(spark):
    items = spark.createDataFrame(
        [("s", 1, 1, "u1", "a"), ("s", 1, 2, "u2", "b"), ("s", 2, 1, "u1", "c"), ("s", 3, 1, "u3", "d"),
         ("s", 2, 2, "u2", "e"), ("t", 1, 1, "u1", "f")],
        "search string, page_no int, a_pos int, url string, title string")
    firsts = first_seen(items, ["search", "url"], ["page_no", "a_pos"])
    assert sorted(tuple(r) for r in firsts.collect()) == [
        ("s", 1, 1, "u1", "a"), ("s", 1, 2, "u2", "b"), ("s", 3, 1, "u3", "d"), ("t", 1, 1, "u1", "f")]
    pages = items.select("search", "page_no").distinct()
    kept = stop_at_empty(firsts, pages, ["search"])
    # page 2 of s adds no unseen URL, so page 3 is never read
    assert sorted((r.search, r.url) for r in kept.collect()) == [("s", "u1"), ("s", "u2"), ("t", "u1")]
