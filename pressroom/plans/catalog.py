"""Queries over the supplied test tables, one per operator of the inventory.

Each function takes (spark, sf_dir) and returns a DataFrame.  Captured feeds,
sitemaps, result pages and URL lists are not in the test tables, so the
queries build them per row from ``pages`` / ``documents`` / ``orders`` /
``events`` / ``part`` columns (whole tables, whole texts) and run the
library operator on them; the oracle states the same computation in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions import text as T
from pressroom.operators import lanes as LN
from pressroom.sources.outlets import outlets_df, select_outlets


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ shared test inputs

FEED_MARK = "utm_source=feed"   # pages already in the store (known set) in the collect queries


def collect_stubs(pages: DataFrame) -> DataFrame:
    """Stubs of three outlets over ``pages``: https pages, '/en/' pages, all pages."""
    base = pages.select(
        F.lit("r1").alias("run_id"), F.lit(1).alias("page_no"), F.col("page_id").alias("stub_ord"), "url",
        F.concat(F.lit("stub "), F.col("page_id").cast("string")).alias("title"), F.lit("").alias("date"))
    a = base.where(F.col("url").startswith("https://")).withColumn("outlet_key", F.lit("conjur"))
    b = base.where(F.col("url").contains("/en/")).withColumn("outlet_key", F.lit("migalhas"))
    c = base.withColumn("outlet_key", F.lit("estadao"))
    return a.unionByName(b).unionByName(c)


def collect_store(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("url").contains(FEED_MARK)).select(
        (F.col("page_id") + 1).alias("row_num"), "url")


def q_collect_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 + L3 + F10 + X14 + X9 lanes, J1, J3, J4, W2, W3 over ``pages``."""
    from pressroom.plans.collect import collect

    pages = load(spark, sf_dir, "pages")
    sel = select_outlets(outlets_df(spark), "conjur,migalhas,estadao")
    res = collect(collect_stubs(pages), pages, sel, collect_store(pages), with_dom=False)
    return res.articles.join(res.texts, "row_num", "left")


def q_collect_bucketed(spark, sf_dir):
    """The flagship over captured pages in a table bucketed by URL: no exchange carries HTML."""
    import uuid

    from pressroom.plans.collect import collect
    from pressroom.sources.captures import write_pages

    pages = load(spark, sf_dir, "pages")
    stored = write_pages(pages, f"captured_pages_{uuid.uuid4().hex}", 16, _scratch(spark, "captured-pages"))
    sel = select_outlets(outlets_df(spark), "conjur,migalhas,estadao")
    res = collect(collect_stubs(pages), stored, sel, collect_store(pages), with_dom=False)
    return res.articles.join(res.texts, "row_num", "left")


def _saved(spark, sf_dir):
    """A run committed, a second one that meets its articles in the store, and the first called again."""
    from pressroom.operators.runstore import import_run
    from pressroom.plans.commands import run_collect

    pages = load(spark, sf_dir, "pages")
    sel = select_outlets(outlets_df(spark), "conjur,migalhas,estadao")
    base = _scratch(spark, "runs")
    import_run(spark, base, collect_store(pages))
    for run in ("run", "run2", "run"):
        run_collect(base, run, collect_stubs(pages), pages, sel, with_dom=False)
    return base


def q_collect_store(spark, sf_dir):
    """Articles and texts of two runs and a replay, read back from their tables."""
    from pressroom.operators.runstore import read, read_texts

    base = _saved(spark, sf_dir)
    articles = read(spark, base, "articles").where("run_id <> 'import'").drop("run_id", "seq")
    return articles.join(read_texts(spark, base), "row_num", "left")


def q_audit_store(spark, sf_dir):
    """The audit records of the first run, read back after a second run and a replay."""
    from pressroom.operators.audit import totals
    from pressroom.operators.runstore import read

    res = read(spark, _saved(spark, sf_dir), "outlet_results").where("run_id = 'run'")
    return totals(res).select("run_id", F.coalesce("outlet", F.lit("__total__")).alias("outlet"),
                              *[F.col(k).cast("long").alias(k) for k in ("hits", "new", "added")])


def q_commit_recovery(spark, sf_dir):
    """A run over ``pages`` cut off after each of its four table writes in turn, then run
    whole, and called once more: every article with the length of its text, and the audit counts."""
    from pressroom.operators import runstore as R
    from pressroom.plans.collect import collect
    from pressroom.plans.commands import run_collect

    pages = load(spark, sf_dir, "pages")
    sel = select_outlets(outlets_df(spark), "conjur,migalhas,estadao")
    base = _scratch(spark, "recovery")
    known = collect_store(pages)
    R.import_run(spark, base, known)
    res = collect(collect_stubs(pages), pages, sel, known, run_id="run", with_dom=False)
    parts = {"articles": res.articles, "texts": res.texts, "outlet_results": res.outlet_results, "runs": R.audit_row(spark, "q", "", None)}
    for stop in range(1, len(parts) + 1):
        attempt = R.begin_attempt()
        for name in list(parts)[:stop]:
            R.write_table(parts[name], base, name, "run", attempt)
    for _ in range(2):
        run_collect(base, "run", collect_stubs(pages), pages, sel, "q", with_dom=False)
    texts = R.read_texts(spark, base).select("row_num", F.length("text").cast("long").alias("n_chars"))
    zero = F.lit(0).cast("long")
    articles = R.read(spark, base, "articles").where("run_id = 'run'").join(texts, "row_num", "left").select(
        F.lit("article").alias("kind"), F.col("url").alias("name"), F.col("row_num").alias("a"), F.coalesce("n_chars", zero).alias("b"), zero.alias("c"))
    results = R.read(spark, base, "outlet_results").select(F.lit("outlet").alias("kind"), F.col("outlet").alias("name"), F.col("hits").alias("a"),
                                                           F.col("new").alias("b"), F.col("added").alias("c"))
    runs = R.read(spark, base, "runs").groupBy("run_id").agg(F.count("*").alias("a")).select(
        F.lit("run").alias("kind"), F.col("run_id").alias("name"), "a", zero.alias("b"), zero.alias("c"))
    return articles.unionByName(results).unionByName(runs)


def q_para_extract(spark, sf_dir):
    """Paragraph lane over every page."""
    pages = load(spark, sf_dir, "pages")
    d = LN.apply_lane(pages.select("page_id", "url", "html"), "paragraph")
    return d.select("page_id", "title", "date", "text", "summary", "ok")


def q_html_text(spark, sf_dir):
    """Readable text of every page."""
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", T.html_to_text("html").alias("text"))


def q_generic_lane(spark, sf_dir):
    """Generic lane, pages passing the 200-character gate."""
    pages = load(spark, sf_dir, "pages")
    d = LN.apply_lane(pages.select("page_id", "url", "html"), "generic")
    return d.where("ok").select("page_id", "url", T.url_host("url", lower=False).alias("outlet"),
                                "title", "date", "summary", F.length("text").cast("long").alias("n_chars"))


def q_title_tag(spark, sf_dir):
    """<title> cut at ' - ' then ' | ', and at ' - ' only."""
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", T.title_tag("html", (" - ", " | ")).alias("title_a"),
                        T.title_tag("html", (" - ",)).alias("title_b"))


def q_url_clean(spark, sf_dir):
    """fetch clean-up, query string drop, absolute form, store key."""
    pages = load(spark, sf_dir, "pages")
    u = F.concat(F.lit(" "), F.col("url"), F.lit("/ "))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1)
    return pages.select(
        "page_id",
        T.url_fetch_clean(u).alias("fetch_url"),
        T.url_drop_query("url").alias("no_query"),
        T.url_absolute(path, "https://www.migalhas.com.br").alias("absolute"),
        T.url_store_clean(F.concat(F.lit(' "'), F.col("url"), F.lit('" '))).alias("store_url"))


# ------------------------------------------------------------------ routing and lanes

# Test registry over the test hosts: a nested domain (T2) and a look-alike substring.
TEST_REGISTRY = [
    ("t_blog", "tionsh.example.net", "meta"),
    ("t_outer", "ththan.example.net", "paragraph"),
    ("t_inner", "blog.ththan.example.net", "paragraph"),
    ("t_org", "thther.example.org", "meta"),
    ("t_look", "ther", "paragraph"),
    ("t_com", "example.com", "meta"),
]


def _pairs():
    return [(k, d) for k, d, _ in TEST_REGISTRY]


def q_route_host(spark, sf_dir):
    """First-match and longest-suffix routing of every page host."""
    from pressroom.operators.route import route

    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", T.url_host("url").alias("host"),
                        route("url", _pairs(), "first").alias("outlet_first"),
                        route("url", _pairs(), "longest").alias("outlet_longest"))


def host_registry(pages: DataFrame) -> DataFrame:
    """A registry of size: every host of ``pages``, the domain of its last two labels, and one that no host has.  Its
    order puts domains of even length first, the longer the earlier, then the others, shorter first."""
    host = T.url_host("url")
    both = pages.select(F.explode(F.array(host, F.substring_index(host, ".", -2), F.concat(F.lit("x."), host))).alias("domain"))
    both = both.where("domain <> ''").distinct()
    n = F.length("domain")
    return both.select(F.concat(F.lit("k:"), F.col("domain")).alias("key"), F.when(n % 2 == 0, -n).otherwise(n).alias("ord"), "domain")


def q_route_table(spark, sf_dir):
    """Routing of every page against a registry table of all hosts, first match and longest suffix."""
    from pressroom.operators.route import route_table

    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    reg = host_registry(pages)
    d = route_table(route_table(pages, reg, mode="first", col="first_key"), reg, mode="longest", col="longest_key")
    return d.select("page_id", "first_key", "longest_key")


def q_lane_dispatch(spark, sf_dir):
    """Lane chosen per page by routing; unrouted pages take the generic lane."""
    from pressroom.operators.route import route

    pages = load(spark, sf_dir, "pages")
    lane_of = F.create_map(*[x for k, _, ln in TEST_REGISTRY for x in (F.lit(k), F.lit(ln))])
    r = route("url", _pairs(), "first")
    d = pages.select("page_id", "url", "html", F.coalesce(F.element_at(lane_of, r), F.lit("generic")).alias("lane"))
    d = d.withColumn("min_chars", F.when(F.col("lane") == "meta", 300).otherwise(200))
    out = LN.regex_dispatch(d, "lane", "html", "url", "min_chars")
    return out.select("page_id", "lane", "title", "date", "summary", "ok",
                      F.length("text").cast("long").alias("n_chars"))


# ------------------------------------------------------------------ feeds and sitemaps

def doc_feeds(spark, sf_dir) -> DataFrame:
    """One RSS body per document: an item per text line, built from the line."""
    docs = load(spark, sf_dir, "documents")
    lines = F.split(F.col("text"), "\n")

    def item(line, i):
        title = line
        title_x = F.when(F.contains(line, F.lit(",")),
                         F.concat(F.lit("<![CDATA[ "), title, F.lit(" ]]>"))).otherwise(title)
        link = F.when(F.length(line) >= 40, F.concat(
            F.lit("<link>https://www."), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"),
            F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"), F.lit("</link>"))).otherwise(F.lit(""))
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") + i).cast("int"))
        pub = F.when(F.contains(line, F.lit("?")), F.lit("not a date")).otherwise(
            F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 23:30:00 -0300")))
        src = F.when(F.contains(line, F.lit(".")), F.concat(
            F.lit('<source url="https://x.example">'), F.col("source"), F.lit("</source>"))).otherwise(F.lit(""))
        return F.concat(F.lit("<item><title>"), title_x, F.lit("</title>"), link,
                        F.lit("<pubDate>"), pub, F.lit("</pubDate>"), src, F.lit("</item>"))

    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(lines, item), ""), F.lit("</channel></rss>"))
    return docs.select("doc_id", "source", xml.alias("xml"))


def q_rss_items(spark, sf_dir):
    """First 25 items of each feed, linked ones kept."""
    from pressroom.sources.feeds import rss_items

    d = rss_items(doc_feeds(spark, sf_dir).drop("source"), max_items=25, site="site.example")
    return d.select("doc_id", "item_pos", "title", "url", "date", "source")


def q_feed_top_n(spark, sf_dir):
    """L1: 25 x max_pages items cut before dropping the ones without a link."""
    from pressroom.sources.feeds import rss_items

    d = rss_items(doc_feeds(spark, sf_dir).drop("source"), max_items=25 * 2)
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.max("item_pos").cast("long").alias("last_pos"))


STRICT_QUERY = "Tion ment, para TION"


def q_rss_strict(spark, sf_dir):
    """Strict items, excluded paths, keyword minimum on the title."""
    from pressroom.sources.feeds import rss_strict

    feeds = doc_feeds(spark, sf_dir).drop("source")
    kws = T.query_tokens(F.lit(STRICT_QUERY), distinct=True)
    d = rss_strict(feeds, kws, exclude=("/de/", "/es/"))
    return d.select("doc_id", "item_pos", "title", "url")


def order_index(spark, sf_dir) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    d = F.date_format("o_orderdate", "yyyy/MM/dd")
    loc = lambda host, n: F.concat(F.lit(f"<sitemap><loc>https://{host}/sitemap/oglobo/"), d,
                                   F.lit("_"), n.cast("string"), F.lit(".xml</loc></sitemap>"))
    xml = F.concat(F.lit("<sitemapindex>"), loc("oglobo.globo.com", F.col("o_custkey")),
                   loc("other.example.com", F.col("o_orderkey")), loc("oglobo.globo.com", F.col("o_orderkey")),
                   F.lit("</sitemapindex>"))
    return orders.select("o_orderkey", xml.alias("xml"))


def q_sitemap_years(spark, sf_dir):
    """Daily sitemap locations of the index, stored by year; years 1996..1999 read back."""
    from pressroom.sources.captures import read_index, write_index
    from pressroom.sources.feeds import sitemap_index

    path = _scratch(spark, "sitemap-index")
    write_index(sitemap_index(order_index(spark, sf_dir)), path)
    return read_index(spark, path, 1996, 1999).select("o_orderkey", "loc_pos", "loc", "year")


def page_sitemaps(pages: DataFrame) -> DataFrame:
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/]+(/[^?#]*)", 1)
    xml = F.concat(F.lit("<urlset><url><loc>  "), F.col("url"), F.lit(" </loc></url><url><loc>https://oglobo.globo.com"),
                   path, F.lit("</loc></url><url><loc>ftp://x.example/a</loc></url></urlset>"))
    return pages.select("page_id", xml.alias("xml"))


SITEMAP_KEYWORDS = ["/en/", "blog", "html"]


def q_sitemap_urls(spark, sf_dir):
    """Host-restricted and blank-tolerant sitemap entries, keyword-filtered."""
    from pressroom.sources.feeds import SITEMAP_ANY_RX, SITEMAP_HOST_RX, sitemap_urls

    sm = page_sitemaps(load(spark, sf_dir, "pages"))
    a = sitemap_urls(sm, pattern=SITEMAP_HOST_RX, keywords=SITEMAP_KEYWORDS).withColumn("kind", F.lit("host"))
    b = sitemap_urls(sm, pattern=SITEMAP_ANY_RX, keywords=SITEMAP_KEYWORDS).withColumn("kind", F.lit("any"))
    return a.unionByName(b).select("page_id", "kind", "loc_pos", "url")


TOPIC_QUERY = "ththan thther blog tionsh"


def page_topics(pages: DataFrame) -> DataFrame:
    lang = F.regexp_extract("url", r"/(en|fr|es|de)/", 1)
    sec = (F.when(lang == "en", "politica").when(lang == "fr", "brasil").when(lang == "es", "economia")
           .otherwise("esportes"))
    host = T.url_host("url")
    num = F.regexp_extract("url", r"/([0-9]+)", 1)
    link = F.concat(F.lit('<a href="https://www.estadao.com.br/'), sec, F.lit("/"), host, F.lit("/"), num,
                    F.lit('/">x</a>'))
    short = F.concat(F.lit('<a href="https://www.estadao.com.br/'), sec, F.lit("/"), num, F.lit('">y</a>'))
    return pages.select("page_id", F.concat(link, short, link).alias("html"))


def q_topic_links(spark, sf_dir):
    """Distinct topic links, >= 5 slashes, keyword on the URL."""
    from pressroom.sources.feeds import topic_links

    kws = T.query_tokens(F.lit(TOPIC_QUERY))
    d = topic_links(page_topics(load(spark, sf_dir, "pages")), keywords=kws)
    return d.select("page_id", "link_pos", "url")


LITERAL_URLS = ["https://inline.example.org/a/", " https://inline.example.org/b "]


def q_url_list(spark, sf_dir):
    """URL file lines built from pages, plus inline URLs, cleaned."""
    from pressroom.sources.feeds import url_lines

    pages = load(spark, sf_dir, "pages")
    content = F.concat_ws("\n", F.col("url"), F.concat(F.lit("# seen "), F.col("url")), F.lit(""),
                          F.concat(F.lit("  # "), F.col("page_id").cast("string")),
                          F.concat(F.lit("  "), F.col("url"), F.lit("/  ")))
    lines = url_lines(pages.select("page_id", content.alias("value")))
    inline = spark.createDataFrame([(-1, i + 1, u) for i, u in enumerate(LITERAL_URLS)],
                                   "page_id long, line_no long, url string")
    d = inline.unionByName(lines)
    return d.select("page_id", "line_no", T.url_fetch_clean("url").alias("url"))


def q_anchor_list(spark, sf_dir):
    """Section links of each host's pages, first seen, stop at a page adding nothing."""
    from pressroom.operators.discovery import dedup_pages_then_stop
    from pressroom.sources.feeds import section_links

    pages = load(spark, sf_dir, "pages").select(
        T.url_host("url").alias("search"),
        F.coalesce(F.regexp_extract("url", r"/([0-9]+)", 1).try_cast("long"), F.col("page_id")).alias("page_no"), "html")
    links = section_links(pages, ("/t", "/a", "/e"), "https://www.migalhas.com.br", "migalhas.com.br")
    out = dedup_pages_then_stop(links.select("search", "page_no", "a_pos", "url", "title"),
                                pages.select("search", "page_no"), ["search"])
    return out.select("search", "page_no", "a_pos", "url", "title")


# ------------------------------------------------------------------ keywords and filters

TOKEN_SUFFIX = " Operação Faroeste, sentença  VENDA venda "


def q_query_tokens(spark, sf_dir):
    """word runs of length >= 4 (repeats kept, and distinct)."""
    part = load(spark, sf_dir, "part")
    qtext = F.concat(F.col("p_name"), F.lit(TOKEN_SUFFIX), F.col("p_name"))
    # arrays shown joined by '|' so both engines hand back plain strings
    return part.select("p_partkey", F.array_join(T.query_tokens(qtext, distinct=False), "|").alias("tokens_all"),
                       F.array_join(T.query_tokens(qtext, distinct=True), "|").alias("tokens"))


URL_KEYWORDS = ["blog", "/en/", ".html"]


def q_kw_any(spark, sf_dir):
    """any keyword in the lower-cased URL; the sitemap outlet's default list."""
    from pressroom.sources.outlets import DEFAULT_URL_KEYWORDS

    pages = load(spark, sf_dir, "pages")
    lc = F.lower("url")
    return pages.select("page_id", T.any_keyword(lc, URL_KEYWORDS).alias("hit"),
                        T.any_keyword(lc, DEFAULT_URL_KEYWORDS).alias("hit_default"))


MIN_MATCH_QUERY = "tion ment that with"


def q_kw_min_match(spark, sf_dir):
    """keyword hits in the lower-cased text, at least min(2, n) required."""
    docs = load(spark, sf_dir, "documents")
    kws = T.query_tokens(F.lit(MIN_MATCH_QUERY))
    title = F.lower("text")
    return docs.select("doc_id", T.keyword_hits(title, kws).cast("long").alias("n_hits"),
                       T.min_keyword_match(title, kws).alias("keep"))


def q_path_exclude(spark, sf_dir):
    """URLs without excluded path segments."""
    pages = load(spark, sf_dir, "pages")
    return pages.where(~T.contains_any("url", ("/de/", "?page="))).select("page_id", "url")


def doc_articles(docs: DataFrame) -> DataFrame:
    """Stored rows built from documents: row number, URL, paywall flag by language."""
    return docs.select(
        (F.col("doc_id") + 1).alias("row_num"),
        F.when(F.col("source") == "src0", F.lit("")).otherwise(F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id").cast("string"))).alias("url"),
        F.when(F.col("lang") == "de", F.lit("yes")).otherwise(F.lit("no")).alias("paywalled"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))


def doc_texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("n_chars") > 2000).select((F.col("doc_id") + 1).alias("row_num"), "text")


def q_missing_texts(spark, sf_dir):
    """Unpaywalled rows without a stored text."""
    from pressroom.operators.store import missing_texts

    docs = load(spark, sf_dir, "documents")
    m = missing_texts(doc_articles(docs), doc_texts(docs))
    return m.where(F.col("paywalled") != "yes").select("row_num", "url")


def q_block_junk(spark, sf_dir):
    """<p> blocks of every page against both outlets' junk rules."""
    from pressroom.operators.domlanes import FOLHA_PHOTO_PREFIX, FOLHA_SKIP, GLOBO_SKIP

    pages = load(spark, sf_dir, "pages")
    ps = F.regexp_extract_all(F.col("html"), F.lit(r"(?s)<p[^>]*>(.+?)</p>"), F.lit(1))
    d = pages.select("page_id", F.posexplode(ps).alias("pos", "raw"))
    t = T.py_strip(F.regexp_replace("raw", r"<[^>]+>", ""))
    d = d.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), t.alias("text"))
    keep_f = ((F.length("text") >= 10) & ~T.contains_any("text", FOLHA_SKIP)
              & ~F.col("text").startswith(FOLHA_PHOTO_PREFIX))
    keep_g = (F.length("text") >= 10) & ~T.contains_any(F.lower("text"), GLOBO_SKIP)
    return d.select("page_id", "pos", F.length("text").cast("long").alias("n_chars"),
                    keep_f.alias("keep_folha"), keep_g.alias("keep_globo"))


def titled_stubs(pages: DataFrame) -> DataFrame:
    s = collect_stubs(pages)
    p = pages.select("url", T.title_tag("html", ()).alias("_t"))
    return (s.join(p, "url").withColumn("title", F.col("_t"))
            .withColumn("date", F.when(F.col("url").contains("#top"), F.lit("2024-03-01")).otherwise(F.lit("")))
            .drop("_t"))


def q_dry_run(spark, sf_dir):
    """new candidates with date or '?' and the title cut to 80."""
    from pressroom.plans.collect import dry_run

    pages = load(spark, sf_dir, "pages")
    return dry_run(titled_stubs(pages), collect_store(pages))


def q_novelty(spark, sf_dir):
    """Pages whose URL is not in the store."""
    from pressroom.operators.store import novelty

    pages = load(spark, sf_dir, "pages")
    return novelty(pages.select("page_id", "url"), collect_store(pages))


def q_back_fill(spark, sf_dir):
    """Extracted title / date fall back to the stub's."""
    pages = load(spark, sf_dir, "pages")
    spam = F.col("url").contains("cheap-pills") | F.col("url").contains("spam-farm")
    x_title = F.when(spam, F.lit("")).otherwise(T.title_tag("html", (" - ", " | ")))
    s_title = T.py_strip(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1))
    s_date = F.when(F.col("url").contains("#top"), F.lit("2024-03-01")).otherwise(F.lit(""))
    return pages.select("page_id", T.first_nonempty(x_title, s_title).alias("title"),
                        T.first_nonempty(T.page_date("html"), s_date).alias("date"))


HOPS = 9        # longest chain of redirects in the query


def q_redirects(spark, sf_dir):
    """Wrapped links resolved through captured redirects: chains of 1 to 9 hops ('/en/' pages), rings of 3
    ('/fr/' pages, kept as they are), unknown ones kept."""
    from pressroom.sources.feeds import resolve_redirects

    pages = load(spark, sf_dir, "pages")
    word = F.col("page_id").cast("string")
    wrapped = F.concat(F.lit("https://news.google.com/rss/articles/"), word)
    stubs = pages.select("page_id", F.lit("wrapped").alias("kind"), wrapped.alias("url")).unionByName(
        pages.where(F.col("url").startswith("http://")).select("page_id", F.lit("plain").alias("kind"), "url"))
    at = lambda j: F.when(j == 0, wrapped).otherwise(F.concat(wrapped, F.lit("/"), j.cast("string")))
    hop = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("j")
    chains = pages.where(F.col("url").contains("/en/")).select("page_id", "url", F.pmod("page_id", F.lit(HOPS)).cast("int").alias("last"))
    chains = chains.select("page_id", "url", "last", hop).select(
        at(F.col("j")).alias("from_url"), F.when(F.col("j") == F.col("last"), F.col("url")).otherwise(at(F.col("j") + 1)).alias("to_url"))
    rings = pages.where(F.col("url").contains("/fr/")).select("page_id", F.lit(2).alias("last")).select("page_id", "last", hop).select(
        at(F.col("j")).alias("from_url"), at((F.col("j") + 1) % 3).alias("to_url"))
    return resolve_redirects(stubs, chains.unionByName(rings)).select("page_id", "kind", "url")


def doc_pages(docs: DataFrame) -> DataFrame:
    """Captured pages of the document URLs: the text as paragraphs."""
    a = doc_articles(docs)
    html = F.concat(F.lit("<html><head><title>"), F.col("title"), F.lit("</title></head><body><article><p>"),
                    F.replace(F.col("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    return a.join(docs.select((F.col("doc_id") + 1).alias("row_num"), "text"), "row_num") \
        .where(F.col("url") != "").select("url", html.alias("html"))


def q_repair_status(spark, sf_dir):
    """A5: refetch of missing texts through routing and lanes, counts by status."""
    from pressroom.plans.repair import repair_texts

    docs = load(spark, sf_dir, "documents")
    _, counts = repair_texts(doc_articles(docs), doc_texts(docs), doc_pages(docs), with_dom=False)
    return counts.select("status", F.col("n").cast("long").alias("n"))


def q_theme_counts(spark, sf_dir):
    """Keyword hits per theme of the default taxonomy."""
    from pressroom.functions.themes import with_themes

    docs = load(spark, sf_dir, "documents")
    d = with_themes(docs.select("doc_id", "text"), "text", guess=None, scores="_s")
    d = d.select("doc_id", F.explode("_s").alias("s"))
    return d.select("doc_id", F.col("s.theme").alias("theme"), F.col("s.n").cast("long").alias("n"))


def q_theme_guess(spark, sf_dir):
    """Arg-max theme, ties to the earlier theme, '' at zero."""
    from pressroom.functions.themes import with_themes

    docs = load(spark, sf_dir, "documents")
    return with_themes(docs.select("doc_id", "text"), "text").select("doc_id", "theme")


# ------------------------------------------------------------------ audit and numbering

def part_themes(spark, sf_dir) -> DataFrame:
    """A taxonomy table from ``part``: a brand's keywords are the words of its parts' names and the first
    three letters of each word; the first letter too for some brands."""
    part = load(spark, sf_dir, "part")
    words = part.select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where("w <> ''")
    forms = words.select("p_brand", F.explode(F.array(F.col("w"), F.substring("w", 1, 3))).alias("keyword"))
    return forms.distinct().select(F.col("p_brand").alias("theme"), F.substring("p_brand", 7, 2).cast("int").alias("theme_ord"), "keyword")


def q_theme_table(spark, sf_dir):
    """Theme scores of every document against a taxonomy table built from ``part``."""
    from pressroom.functions.themes import theme_scores_join

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return theme_scores_join(docs, part_themes(spark, sf_dir), "doc_id", "text")


def q_theme_table_guess(spark, sf_dir):
    """The best theme of every document by a caller's taxonomy table."""
    from pressroom.functions.themes import guess_theme_join

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return guess_theme_join(docs, part_themes(spark, sf_dir), "doc_id", "text")


def event_runs(spark, sf_dir):
    ev = load(spark, sf_dir, "events").withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
    res = ev.groupBy("run_id", "event_type").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("value") >= 10).alias("new"),
        F.count_if(F.col("value") >= 30).alias("added"))
    res = res.select("run_id", F.col("event_type").alias("outlet"), F.col("event_type").alias("sel_ord"),
                     F.lit(1).cast("long").alias("pages"), "hits", "new", "added",
                     F.when(F.col("event_type") == "error",
                            F.concat(F.lit("search failed: "), F.col("hits").cast("string"), F.lit(" errors")))
                     .otherwise(F.lit("")).alias("note"))
    runs = ev.groupBy("run_id").agg(F.min("ts").alias("ts")).select(
        "run_id", "ts",
        F.concat(F.when(F.dayofweek("ts") == 1, F.lit("o'clock ")).otherwise(F.lit("")), F.lit("events "),
                 F.col("run_id")).alias("query"),
        F.when(F.dayofmonth("ts") % 2 == 0, F.concat(F.lit("ctx "), F.col("run_id"))).otherwise(F.lit(""))
        .alias("project_context"))
    return runs, res


def q_audit_render(spark, sf_dir):
    """One markdown block per run (day) with a line per outlet (event type)."""
    from pressroom.operators.audit import render

    runs, res = event_runs(spark, sf_dir)
    return render(runs, res)


def q_row_numbers(spark, sf_dir):
    """Rows appended after the store, numbered from max + 1 in (source, doc_id) order."""
    from pressroom.operators.numbering import number_rows

    docs = load(spark, sf_dir, "documents")
    store = docs.where(F.col("lang") == "en").select((F.col("doc_id") + 1).alias("row_num"))
    base = store.agg(F.coalesce(F.max("row_num"), F.lit(0)) + 1).scalar()
    new = docs.where(F.col("lang") != "en").select("doc_id", "source")
    return number_rows(new, ["source", "doc_id"], base=base).select("doc_id", "row_num")


def dup_stubs(pages: DataFrame) -> DataFrame:
    s = collect_stubs(pages)
    extra = (s.where(F.col("outlet_key") == "estadao")
             .withColumn("url", F.split_part(F.col("url"), F.lit("#"), F.lit(1))).withColumn("page_no", F.lit(2)))
    return s.unionByName(extra)


def q_first_seen(spark, sf_dir):
    """Union of three outlets' stubs with repeats, first seen per outlet and URL."""
    from pressroom.operators.discovery import first_seen

    s = dup_stubs(load(spark, sf_dir, "pages"))
    return first_seen(s, ["outlet_key", "url"], ["page_no", "stub_ord"]).select(
        "outlet_key", "url", F.col("page_no").cast("long").alias("page_no"), "stub_ord", "title")


def _collect(spark, sf_dir):
    from pressroom.plans.collect import collect

    pages = load(spark, sf_dir, "pages")
    sel = select_outlets(outlets_df(spark), "conjur,migalhas,estadao")
    return collect(collect_stubs(pages), pages, sel, collect_store(pages), with_dom=False)


def q_winner(spark, sf_dir):
    """Per stub in_store / ok / is_new / is_winner."""
    c = _collect(spark, sf_dir).stubs
    return c.select("outlet_key", "url", "stub_ord", "in_store", "ok", "is_new", "is_winner")


def q_known_growth(spark, sf_dir):
    """The known URL set after the run."""
    from pressroom.operators.store import known_urls

    pages = load(spark, sf_dir, "pages")
    res = _collect(spark, sf_dir)
    return known_urls(collect_store(pages)).union(res.articles.select("url")).distinct()


def q_collect_counts(spark, sf_dir):
    """Hits / new / added per outlet and the run total (rollup)."""
    from pressroom.operators.audit import totals

    res = _collect(spark, sf_dir).outlet_results
    t = totals(res)
    return t.select("run_id", F.coalesce("outlet", F.lit("__total__")).alias("outlet"),
                    *[F.col(k).cast("long").alias(k) for k in ("hits", "new", "added")])


PAGE_STOP_MAX = 60


def q_page_stop(spark, sf_dir):
    """Result pages 1..60 per search, stop at the first page without results."""
    from pressroom.operators.discovery import page_window, result_offset, stop_at_empty

    ev = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("search"), F.dayofyear("ts").alias("page_no"), "event_id", "value")
    ev = page_window(ev, PAGE_STOP_MAX)
    items = ev.where(F.col("value") >= 49)
    out = stop_at_empty(items.select("search", "page_no", "event_id"), ev, ["search"])
    return out.select("search", F.col("page_no").cast("long").alias("page_no"), "event_id",
                      result_offset("page_no").cast("long").alias("offset"))


# ------------------------------------------------------------------ meta, dates, summaries

def q_meta_title(spark, sf_dir):
    """Og:title (present on https pages) before the cut <title> / the <h1>."""
    pages = load(spark, sf_dir, "pages")
    h1 = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    og = F.when(F.col("url").startswith("https"),
                F.concat(F.lit('<meta property="og:title" content="'), h1, F.lit('">'))).otherwise(F.lit(""))
    head = F.concat(og, F.col("html"))
    return pages.select(
        "page_id",
        T.first_nonempty(T.meta_property(head, "og:title"), T.title_tag(head, (" - ", " | "))).alias("t_meta"),
        T.first_nonempty(T.meta_property(head, "og:title"),
                         T.py_strip(F.regexp_replace(h1, r"<[^>]+>", ""))).alias("t_h1"))


def order_heads(orders: DataFrame) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    html = (F.when(F.col("o_orderstatus") == "F",
                   F.concat(F.lit('<meta property="article:published_time" content="'), d, F.lit('-03:00">')))
            .when(F.col("o_orderstatus") == "O",
                  F.concat(F.lit('<script>{"datePublished" : "'), d, F.lit('"}</script>')))
            .otherwise(F.concat(F.lit('<time class="x" datetime="'), d, F.lit('">'))))
    return orders.select("o_orderkey", html.alias("html"))


def q_page_date(spark, sf_dir):
    """Date chain with and without the <time> fallback."""
    h = order_heads(load(spark, sf_dir, "orders"))
    return h.select("o_orderkey", T.page_date("html", True).alias("d_meta"),
                    T.page_date("html", False).alias("d_para"))


def q_pt_date(spark, sf_dir):
    """Portuguese dotted dates -> year-month (and the year-day form)."""
    orders = load(spark, sf_dir, "orders")
    mon = F.element_at(F.array(*[F.lit(m) for m in T.PT_MONTHS]), F.month("o_orderdate"))
    mon = F.when(F.col("o_orderpriority").startswith("1"), F.lit("xyz")).otherwise(mon)
    txt = F.concat(F.lit("Publicado em "), F.dayofmonth("o_orderdate").cast("string"), F.lit("."), mon, F.lit("."),
                   F.year("o_orderdate").cast("string"), F.lit(" às 10h"))
    return orders.select("o_orderkey", T.pt_dotted_month(txt).alias("month"),
                         T.pt_dotted_month(txt, mode="day").alias("day_form"))


def q_summary_lines(spark, sf_dir):
    """Long-line summary, second chunk, first 300 characters."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", T.lines_summary("text").alias("s_lines"), T.second_chunk("text").alias("s_chunk"),
                       F.substring("text", 1, 300).alias("s_first"))


def q_text_names(spark, sf_dir):
    """S3: zero-padded text names (at least three digits)."""
    from pressroom.operators.store import text_key

    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", text_key(F.col("doc_id") + 1).alias("name"),
                       text_key(F.col("doc_id") * 7 + 1).alias("name_wide"))


def q_stub_pages(spark, sf_dir):
    """Stub URLs looked up in the captured pages; missing = failed fetch."""
    pages = load(spark, sf_dir, "pages")
    stubs = pages.select("url").unionByName(
        pages.where(F.col("url").contains("#top")).select(F.concat("url", F.lit("x")).alias("url")))
    d = stubs.join(pages.select("url", "html"), "url", "left")
    return d.select("url", F.col("html").isNotNull().alias("fetched"),
                    F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n_chars"))


SELECT_REQUEST = " T_blog, t_org,unknown, t_look ,t_com,t_inner"


def test_outlets(spark):
    from pressroom.sources.outlets import outlets_df

    rows = [(k, k.upper(), d, "disabled" if k == "t_look" else "working", "native", 200, ln)
            for k, d, ln in TEST_REGISTRY]
    return outlets_df(spark, rows)


def q_outlet_select(spark, sf_dir):
    """Requested outlets (stripped, lower-cased, unknown and disabled
    dropped, request order) with the number of pages routed to each."""
    from pressroom.operators.route import route

    pages = load(spark, sf_dir, "pages")
    sel = select_outlets(test_outlets(spark), SELECT_REQUEST)
    counts = pages.select(route("url", _pairs(), "first").alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_pages"))
    d = sel.join(counts, "key", "left")
    return d.select("key", F.col("sel_ord").cast("long").alias("sel_ord"), "name", "status", "search",
                    F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"))


# ------------------------------------------------------------------ DOM lanes

def doc_article_html(spark, sf_dir) -> DataFrame:
    """Article HTML per document in the three outlets' layouts, chosen by language:
    en -> folha body / globo container / piaui .post-content; fr -> itemprop body;
    es -> no subtitle, 'article' only; de -> no body container at all."""
    docs = load(spark, sf_dir, "documents")
    # non-blank lines, '&' escaped as HTML text must be
    docs = docs.withColumn("_lines", F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.length(T.py_strip(x)) > 0),
        lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))))
    lines = F.col("_lines")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    second = F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))
    paras = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.when(
        (i % 7) == 3, F.concat(F.lit("<h3>"), x, F.lit("</h3>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))), "")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int"))
    mon = F.element_at(F.array(*[F.lit(m) for m in T.PT_MONTHS]), F.month(day))
    pt = F.concat(F.dayofmonth(day).cast("string"), F.lit("."), mon, F.lit("."), F.year(day).cast("string"))
    lang = F.col("lang")
    open_body = (F.when(lang == "en", F.lit('<div class="c-news__body article__content-container post-content">'))
                 .when(lang == "fr", F.lit('<div itemprop="articleBody" class="entry-content">'))
                 .when(lang == "es", F.lit('<div class="content-text">'))
                 .otherwise(F.lit("<section>")))
    sub = F.when(lang == "es", F.lit("")).otherwise(
        F.concat(F.lit('<h2 class="c-news__subtitle">'), second, F.lit("</h2>")))
    art_open = F.when(lang == "de", F.lit("<main>")).otherwise(F.lit("<article>"))
    art_close = F.when(lang == "de", F.lit("</main>")).otherwise(F.lit("</article>"))
    html = F.concat(
        F.lit('<html><head><title>'), first, F.lit(" - Jornal</title>"),
        F.lit('<meta property="og:description" content="'), F.regexp_replace(second, '"', ""), F.lit('">'),
        F.lit('<meta property="article:published_time" content="'), F.date_format(day, "yyyy-MM-dd"),
        F.lit('T08:00:00-03:00"><script>var t="<p>x</p>";</script></head><body>'),
        F.lit("<header><h1>Menu do jornal</h1></header><nav><a href=\"/a\">Assine</a></nav>"),
        art_open, F.lit("<h1>"), first, F.lit("</h1>"), sub,
        F.lit('<p class="c-news__author">Por '), F.col("source"), F.lit("</p><time>"), pt, F.lit("</time>"),
        open_body, paras, F.lit('<div class="c-ad ad"><p>Publicidade longa o bastante</p></div>'),
        F.lit("<p>Carregando comentarios do leitor</p></div>"), art_close,
        F.lit("<footer><p>Rodape com texto longo</p></footer></body></html>"))
    return docs.select("doc_id", F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/a/"),
                                          F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


def q_html_blocks(spark, sf_dir):
    """The element table of every page."""
    from pressroom.operators.htmlblocks import el_text, html_page

    pages = load(spark, sf_dir, "pages")
    d = pages.select("page_id", html_page("html").alias("pg"))
    d = d.select("page_id", F.explode(F.transform("pg.els", lambda x: F.struct(
        x["ord"].alias("ord"), x["tag"].alias("tag"), x["depth"].alias("depth"),
        F.length(el_text(F.col("pg.nodes"), x)).alias("n_chars")))).alias("b"))
    return d.select("page_id", *[F.col(f"b.{k}").cast("long").alias(k) if k != "tag" else F.col("b.tag")
                                 for k in ("ord", "tag", "depth", "n_chars")])


def _dom(spark, sf_dir, lane: str, min_chars: int):
    from pressroom.operators.domlanes import RULES, dom_dispatch
    from pressroom.operators.selectors import rules_from_df

    rules = rules_from_df(spark.createDataFrame(RULES, "outlet string, role string, ord int, selector string"))
    d = doc_article_html(spark, sf_dir).withColumn("lane", F.lit(lane)).withColumn("min_chars", F.lit(min_chars))
    out = dom_dispatch(d, rules=rules)
    return out.select("doc_id", "title", "date", "summary", "ok", F.length("text").cast("long").alias("n_chars"))


def q_folha_text(spark, sf_dir):
    """Folha DOM lane over article HTML built from documents."""
    return _dom(spark, sf_dir, "folha", 300)


def q_globo_text(spark, sf_dir):
    """Globo DOM lane."""
    return _dom(spark, sf_dir, "globo", 300)


def q_piaui_text(spark, sf_dir):
    """Piaui container cascade."""
    return _dom(spark, sf_dir, "piaui", 200)


def q_result_list(spark, sf_dir):
    """Result-list items of list HTML built from each document's lines."""
    from pressroom.operators.discovery import stop_at_empty
    from pressroom.operators.domlanes import result_items

    docs = load(spark, sf_dir, "documents")
    lines = F.split("text", "\n")

    def li(x, i):
        href = F.when(F.length(x) > 20, F.concat(
            F.lit('<a href="https://www1.folha.uol.com.br/poder/2024/'), F.col("doc_id").cast("string"), F.lit("-"),
            i.cast("string"), F.lit('.shtml?origin=busca">'), F.replace(x, F.lit("&"), F.lit("&amp;")),
            F.lit("</a>"))).otherwise(
            F.lit('<a href="https://other.example.com/x">outra</a>'))
        return F.concat(F.lit('<li class="c-headline"><a href="https://www1.folha.uol.com.br/x"></a>'), href,
                        F.lit('<span class="c-headline__dateline">'), (i % 28 + 1).cast("string"),
                        F.lit(".mar.2024</span></li>"))

    html = F.concat(F.lit("<html><body><ol>"), F.array_join(F.transform(lines, li), ""), F.lit("</ol></body></html>"))
    pages = docs.select(F.col("source").alias("search"), (F.col("doc_id") + 1).alias("page_no"), html.alias("html"))
    items = result_items(pages)
    out = stop_at_empty(items, pages.select("search", "page_no"), ["search"])
    return out.select("search", "page_no", "item_pos", "url", "title", "date")


# ------------------------------------------------------------------ stories CSV and streaming ingest

def _scratch(spark, name: str) -> str:
    import uuid

    from pressroom.session import shared_path

    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def doc_stories(docs: DataFrame) -> DataFrame:
    """Stories rows built from documents, with the awkward CSV cases in them."""
    lines = F.split("text", "\n")
    return docs.select(
        (F.col("doc_id") + 1).alias("row_num"),
        F.when(F.col("lang") == "en", F.lit("2024-03")).otherwise(
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")), "yyyy-MM-dd")
        ).alias("date"),
        F.col("source").alias("outlet"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit(' "https://'), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id").cast("string"),
                 F.lit('" ')).alias("url"),
        F.lit("").alias("theme"),
        F.concat(F.col("text"), F.lit(' "q", x')).alias("summary"),
        F.when(F.col("lang") == "de", F.lit(" YES ")).when(F.col("lang") == "fr", F.lit("")).otherwise(F.lit("no"))
        .alias("paywalled"))


def q_articles_scan(spark, sf_dir):
    """Stories CSV written from documents and read back by header."""
    from pressroom.operators.store import read_stories_csv, write_stories_csv

    path = _scratch(spark, "stories")
    write_stories_csv(doc_stories(load(spark, sf_dir, "documents")), path)
    return read_stories_csv(spark, path)


def q_articles_roundtrip(spark, sf_dir):
    """Whole texts (many lines, quotes, commas) through the stories CSV and back."""
    from pressroom.operators.store import read_stories_csv, write_stories_csv

    docs = load(spark, sf_dir, "documents")
    rows = docs.select((F.col("doc_id") + 1).alias("row_num"), F.lit("").alias("date"),
                       F.col("lang").alias("outlet"), F.when(F.col("lang") == "en", F.lit("")).otherwise(
                           F.col("source")).alias("title"),
                       F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")).alias("url"),
                       F.lit("").alias("theme"), F.col("text").alias("summary"), F.lit("no").alias("paywalled"))
    path = _scratch(spark, "roundtrip")
    write_stories_csv(rows, path)
    return read_stories_csv(spark, path).select("row_num", "outlet", "title", "url", "summary")


# Deliveries of captured pages, in arrival order: by language, a replay, an overlap.
def deliveries():
    u = F.col("url")
    return [
        ("en", u.contains("/en/")),
        ("fr", u.contains("/fr/")),
        ("es", u.contains("/es/")),
        ("rest", ~(u.contains("/en/") | u.contains("/fr/") | u.contains("/es/"))),
        ("replay", u.contains("/en/")),
        ("https", u.startswith("https://")),
    ]


def q_incremental_ingest(spark, sf_dir):
    """Pages arriving in six deliveries through the streaming ingest; final store."""
    from pressroom.functions.text import title_tag
    from pressroom.streaming.ingest import run_available

    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    root = _scratch(spark, "ingest")
    landing, store, ckpt = f"{root}/landing", f"{root}/store", f"{root}/checkpoint"
    schema = pages.schema
    for name, cond in deliveries():
        pages.where(cond).write.mode("append").parquet(landing)
        run_available(spark, landing, schema, store, ckpt,
                      project=lambda b: b.select("page_id", "url", title_tag("html").alias("title")))
    return spark.read.parquet(store).select("row_num", "page_id", "url", "title")


def q_fetch_run(spark, sf_dir):
    """The fetch command over a URL list built
    from pages plus inline URLs: cleaned, known ones dropped, routed, extracted,
    first success per URL stored and numbered in list order."""
    from pressroom.plans.repair import fetch_urls
    from pressroom.sources.feeds import url_lines

    pages = load(spark, sf_dir, "pages")
    content = F.concat_ws("\n", F.col("url"), F.concat(F.lit("# seen "), F.col("url")), F.lit(""),
                          F.concat(F.lit("  "), F.col("url"), F.lit("/  ")))
    lines = url_lines(pages.select("page_id", content.alias("value"))).withColumn("src_ord", F.lit(1))
    inline = spark.createDataFrame([(0, -1, i + 1, u) for i, u in enumerate(LITERAL_URLS)],
                                   "src_ord int, page_id long, line_no long, url string")
    urls = inline.unionByName(lines)
    registry = [(k, d, ln, 300 if ln == "meta" else 200, k.upper()) for k, d, ln in TEST_REGISTRY]
    out = fetch_urls(urls, collect_store(pages), pages.select("url", "html"), registry=registry,
                     with_dom=False, order=("src_ord", "page_id", "line_no"))
    return out.select("row_num", "date", "outlet", "title", "url", "summary",
                      F.length("text").cast("long").alias("n_chars"))


def q_collect_dom(spark, sf_dir):
    """collect with DOM lanes (X10-X13 inside X18): document articles found by the
    folha, globo and piaui outlets, extracted by their DOM rules, winner per URL,
    numbered."""
    from pressroom.plans.collect import collect

    pages = doc_article_html(spark, sf_dir).select("doc_id", "url", "html")
    base = pages.select(F.lit("r1").alias("run_id"), F.lit(1).alias("page_no"), F.col("doc_id").alias("stub_ord"),
                        "url", F.lit("").alias("title"), F.lit("").alias("date"))
    lang = F.regexp_extract("url", r"/a/([0-9]+)$", 1)
    stubs = (base.withColumn("outlet_key", F.lit("globo"))
             .unionByName(base.where(F.length(lang) % 2 == 0).withColumn("outlet_key", F.lit("folha")))
             .unionByName(base.withColumn("outlet_key", F.lit("piaui"))))
    known = pages.where(F.col("doc_id") < 0).select(F.lit(1).cast("long").alias("row_num"), "url")
    sel = select_outlets(outlets_df(spark), "folha,globo,piaui")
    res = collect(stubs, pages.select("url", "html"), sel, known, with_dom=True)
    return res.articles.join(res.texts.select("row_num", F.length("text").cast("long").alias("n_chars")),
                             "row_num", "left")


# ------------------------------------------------------------------ discovery from captured bodies

FEED_QUERY, FEED_PAGES, FEED_YEAR = "Tribunal, sentença", 3, 2026


def captured_bodies(spark, sf_dir) -> DataFrame:
    """Captured bodies of all six outlets, built from each document's id and language: feeds with wrapped and foreign
    links, section links on five pages, strict items and topic links, dated sitemaps and their
    index, result lists, blank-padded sitemaps."""
    d, lang = F.col("doc_id").cast("string"), F.col("lang")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    cat = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    page = (F.pmod("doc_id", F.lit(5)) + 1).cast("int")
    day = cat("https://oglobo.globo.com/sitemap/oglobo/", (F.pmod("doc_id", F.lit(27)) + 2000).cast("string"), "/01/02_", d, ".xml")
    title = F.when(lang == "en", cat("<title><![CDATA[Sentença do Tribunal ", d, "]]></title>")).when(
        lang == "fr", cat("<title>Sentença do Tribunal ", d, "</title>")).otherwise(cat("<title><![CDATA[Tribunal ", d, "]]></title>"))
    head = F.when(lang == "de", "").otherwise(cat("Manchete &amp; ", d))
    bodies = [
        ("conjur", "rss", cat("rss", d), F.lit(1), cat(
            "<item><title>C ", d, "</title><link>https://www.conjur.com.br/", d, "</link><pubDate>Tue, 05 Mar 2024 23:30:00 -0300</pubDate></item>"
            "<item><title>W</title><link>https://news.google.com/rss/articles/", d, "</link></item>"
            "<item><title>F</title><link>https://other.example/", d, "</link></item>")),
        ("migalhas", "results", cat("m", d), page, cat(
            "<p><a href='/quentes/?n=", F.pmod("doc_id", F.lit(50)).cast("string"), "&amp;x'>Q</a><a href=\"/depeso/", d, "\">D <b>", d,
            "</b></a><a href=/outra/", d, ">O</a></p>")),
        ("estadao", "rss", cat("e", d), F.lit(1), cat("<item>", title, "<link>https://www.estadao.com.br/", lang, "/", d, "</link></item>")),
        ("estadao", "topic", cat("t", d), F.lit(1), cat(
            '<a href="https://www.estadao.com.br/politica/', lang, "/tribunal-", d, '/">a</a><a href="https://www.estadao.com.br/esportes/', lang,
            "/tribunal-", d, '/">b</a><a href="https://www.estadao.com.br/brasil/', lang, "/outro-", d, '/">c</a>')),
        ("globo", "sitemap_index", cat("i", d), F.lit(1), cat("<loc>", day, "</loc>")),
        ("globo", "sitemap", day, F.lit(1), cat(
            "<loc>https://oglobo.globo.com/", lang, "/tribunal-", F.pmod("doc_id", F.lit(100)).cast("string"),
            "</loc><loc>https://oglobo.globo.com/outra-", d, "</loc>")),
        ("folha", "results", cat("f", d), page, cat(
            "<ol><li class='c-headline'><a href='https://www1.folha.uol.com.br/", d, ".shtml?o=1'>", head, "</a><time>12.mar.2024</time></li></ol>")),
        ("piaui", "sitemap", cat("p", d), F.lit(1), cat(
            "<loc> https://piaui.folha.uol.com.br/", lang, "-TRIBUNAL-", d, " </loc><loc>https://piaui.folha.uol.com.br/x", d, "</loc>")),
    ]
    made = F.array(*[F.struct(f.alias("feed_id"), F.lit(o).alias("outlet_key"), F.lit(k).alias("kind"), p.alias("page_no"), x.alias("xml"))
                     for o, k, f, p, x in bodies])
    return docs.where(lang.isNotNull() & F.col("doc_id").isNotNull()).select(F.explode(made).alias("b")).select("b.*")


def captured_redirects(spark, sf_dir) -> DataFrame:
    """Wrapped links of English documents lead to the outlet in two hops, others to another site."""
    d = F.col("doc_id").cast("string")
    docs = load(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    first = F.concat(F.lit("https://news.google.com/rss/articles/"), d)
    then = F.concat(F.lit("https://short.example/"), d)
    last = F.when(F.col("lang") == "en", F.concat(F.lit("https://www.conjur.com.br/w/"), d)).otherwise(F.concat(F.lit("https://foreign.example/"), d))
    pairs = F.array(F.struct(first.alias("from_url"), then.alias("to_url")), F.struct(then.alias("from_url"), last.alias("to_url")))
    return docs.select(F.explode(pairs).alias("r")).select("r.*").distinct()


def _discover(key: str):
    def query(spark, sf_dir):
        from pressroom.plans.discover import search

        return search(captured_bodies(spark, sf_dir), key, FEED_QUERY, FEED_PAGES, FEED_YEAR, captured_redirects(spark, sf_dir))

    query.__name__ = f"q_discover_{key}"
    query.__doc__ = f"N1-N3, U2, U4: the search of {key}, compiled from its rule rows, over captured bodies."
    return query


DISCOVER = {k: _discover(k) for k in ("conjur", "migalhas", "estadao", "globo", "folha", "piaui")}


def q_collect_from_feeds(spark, sf_dir):
    """collect from discovery to audit: all six searches, novelty against a store of Spanish pages, pages captured for
    French documents of the first outlet; hits, new and added by outlet."""
    from pressroom.plans.collect import collect
    from pressroom.plans.discover import search_all

    docs = load(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull())
    url = F.concat(F.lit("https://www.conjur.com.br/"), F.col("doc_id").cast("string"))
    store = docs.where("lang = 'es'").select((F.col("doc_id") + 1).alias("row_num"), url.alias("url")).distinct()
    pages = docs.where("lang = 'fr'").select(url.alias("url"), F.concat(F.lit("<p>"), F.repeat(F.lit("x"), F.lit(400)), F.lit("</p>")).alias("html"))
    stubs, notes = search_all(captured_bodies(spark, sf_dir), FEED_QUERY, list(DISCOVER), FEED_PAGES, FEED_YEAR, captured_redirects(spark, sf_dir))
    sel = select_outlets(outlets_df(spark), ",".join(DISCOVER))
    res = collect(stubs, pages.distinct(), sel, store, run_id="run", max_pages=FEED_PAGES, notes=notes)
    return res.outlet_results.select("outlet", "hits", "new", "added")
