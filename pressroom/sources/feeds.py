"""Discovery sources over captured bodies: RSS feeds, sitemaps, link lists, URL files.

Every function takes a DataFrame holding one captured body per row and
returns one row per discovered item, keeping the body's own key columns.
The body is parsed with built-in regex functions and ``posexplode``; the
position column keeps document order, which later first-seen / winner
rules use as a tie-break.  Nothing here collects across rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.functions import text as T
from pressroom.session import materialize

# Fixed value: an RSS item.
ITEM_RX = r"(?s)<item>(.*?)</item>"
# Strict RSS item patterns (CDATA title, https link).
STRICT_TITLE_RX = r"<title><!\[CDATA\[(.*?)\]\]></title>"
STRICT_LINK_RX = r"<link>(https://[^<]+)</link>"
# Daily sitemap index entries and article entries of the sitemap outlet.
SITEMAP_INDEX_RX = r"<loc>(https://oglobo\.globo\.com/sitemap/oglobo/([0-9]{4})/[0-9]{2}/[0-9]{2}_[0-9]+\.xml)</loc>"
SITEMAP_HOST_RX = r"<loc>(https://oglobo\.globo\.com/[^<]+)</loc>"
SITEMAP_ANY_RX = r"<loc>[\t\n\x0B\f\r ]*(https?://[^<]+)[\t\n\x0B\f\r ]*</loc>"
# Topic-page article links and their sections.
TOPIC_RX = r'href="(https://www\.estadao\.com\.br/(?:politica|brasil|economia)/[^"]+)"'


def _keep(df: DataFrame, drop: Iterable[str]) -> list[str]:
    return [c for c in df.columns if c not in set(drop)]


def rss_items(feeds: DataFrame, xml: str = "xml", max_items: int | Column | None = None,
              site: str | Column | None = None) -> DataFrame:
    """S4 + L1: items of each feed -> item_pos, title, url, date, source.

    The first ``max_items`` items are taken before items without a link are
    dropped; CDATA is unwrapped; the source falls back to ``site``.
    """
    items = F.regexp_extract_all(F.col(xml), F.lit(ITEM_RX), F.lit(1))
    if max_items is not None:
        n = max_items if isinstance(max_items, Column) else F.lit(int(max_items))
        items = F.slice(items, F.lit(1), n)
    keep = _keep(feeds, [xml])
    d = feeds.select(*keep, F.posexplode(items).alias("item_pos", "_item"))
    fallback = site if isinstance(site, Column) else F.lit(site or "")
    d = d.select(
        *keep, (F.col("item_pos") + 1).cast("long").alias("item_pos"),
        T.clean(T.tag_text("_item", "title")).alias("title"),
        T.tag_text("_item", "link").alias("url"),
        T.rfc822_day(T.tag_text("_item", "pubDate")).alias("date"),
        T.first_nonempty(T.source_text("_item"), fallback).alias("source"))
    return d.where(F.col("url") != "")


def rss_strict(feeds: DataFrame, keywords, xml: str = "xml",
               exclude: Iterable[str] = ("/pulsa/", "/web-stories/", "/nutricao/")) -> DataFrame:
    """S5 + F3 + F4: CDATA title and https link required, excluded paths
    dropped, at least min(2, #keywords) keywords in the lower-cased title."""
    keep = _keep(feeds, [xml])
    d = feeds.select(*keep, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(ITEM_RX), F.lit(1)))
                     .alias("item_pos", "_item"))
    d = d.select(*keep, (F.col("item_pos") + 1).cast("long").alias("item_pos"),
                 F.regexp_extract("_item", STRICT_TITLE_RX, 1).alias("title"),
                 F.regexp_extract("_item", STRICT_LINK_RX, 1).alias("url"),
                 F.col("_item").rlike(STRICT_TITLE_RX).alias("_has_t"))
    d = d.where(F.col("_has_t") & (F.col("url") != ""))
    d = d.where(~T.contains_any("url", exclude))
    return d.where(T.min_keyword_match(F.lower("title"), keywords)).drop("_has_t")


def sitemap_index(feeds: DataFrame, xml: str = "xml", year_from: int | None = None,
                  year_to: int | None = None, pattern: str = SITEMAP_INDEX_RX) -> DataFrame:
    """S6 + F7: daily sitemap locations with the year from their path."""
    keep = _keep(feeds, [xml])
    locs = F.regexp_extract_all(F.col(xml), F.lit(pattern), F.lit(1))
    d = feeds.select(*keep, F.posexplode(locs).alias("loc_pos", "loc"))
    d = d.withColumn("loc_pos", (F.col("loc_pos") + 1).cast("long")).withColumn(
        "year", F.regexp_extract("loc", pattern.replace("<loc>(", "^(").replace(")</loc>", ")$"), 2).try_cast("int"))
    if year_from is not None and year_to is not None:
        d = d.where(F.col("year").between(year_from, year_to))
    return d


def sitemap_urls(feeds: DataFrame, xml: str = "xml", pattern: str = SITEMAP_HOST_RX,
                 keywords=None) -> DataFrame:
    """S7 (+ F2): article locations of sitemap bodies, optionally keyword-filtered on the URL."""
    keep = _keep(feeds, [xml])
    locs = F.regexp_extract_all(F.col(xml), F.lit(pattern), F.lit(1))
    d = feeds.select(*keep, F.posexplode(locs).alias("loc_pos", "url"))
    d = d.withColumn("loc_pos", (F.col("loc_pos") + 1).cast("long"))
    if keywords is not None:
        d = d.where(T.any_keyword(F.lower("url"), keywords))
    return d


def section_links(pages: DataFrame, sections: Iterable[str], base: str, domain: str,
                  html: str = "html") -> DataFrame:
    """S9 + F5 + F6: links of the parsed pages (entities decoded, any quoting) under the given sections, made
    absolute, on the domain."""
    from pressroom.operators.domlanes import links

    a = links(pages, html).drop("item", "ord").where(T.contains_any("href", sections))
    a = a.withColumn("url", T.url_absolute("href", base))
    return a.where(F.col("url").contains(domain)).drop("href")


def topic_links(pages: DataFrame, keywords=None, html: str = "html", pattern: str = TOPIC_RX,
                min_slashes: int = 5) -> DataFrame:
    """Distinct article links of a topic page (first-occurrence order),
    at least ``min_slashes`` slashes, optionally keyword-filtered."""
    keep = _keep(pages, [html])
    urls = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)))
    d = pages.select(*keep, F.posexplode(urls).alias("link_pos", "url"))
    d = d.withColumn("link_pos", (F.col("link_pos") + 1).cast("long")).where(T.slash_count("url") >= min_slashes)
    if keywords is not None:
        d = d.where(T.any_keyword(F.lower("url"), keywords))
    return d


def url_lines(files: DataFrame, content: str = "value") -> DataFrame:
    """One URL per line; blank lines and lines starting with '#' (before
    stripping) are dropped; the rest stripped."""
    keep = _keep(files, [content])
    d = files.select(*keep, F.posexplode(F.split(F.col(content), "\n")).alias("line_no", "_line"))
    d = d.where((T.py_strip("_line") != "") & ~F.col("_line").startswith("#"))
    return d.select(*keep, (F.col("line_no") + 1).cast("long").alias("line_no"), T.py_strip("_line").alias("url"))


def read_url_file(spark, path: str) -> DataFrame:
    """S11 over a text file: (file, line_no, url) in file order."""
    raw = spark.read.option("wholetext", True).text(path)
    return url_lines(raw.withColumn("file", F.col("_metadata.file_path")))


# Fixed value: host marker of wrapped (redirecting) news links.
WRAPPED_MARKER = "news.google.com"


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """(from_url, to_url): where the chain of redirects from each URL ends; URLs on or before a ring have no row.

    Pointer jumping: in each round every chain that has not ended takes over the target of its
    target, so n hops take about log2(n) rounds; each round that ends no further chain has met rings
    only and is the last.  A URL captured with several targets follows the least.  Each round is an
    equi-join written to the checkpoint folder, the right side unique per key.
    """
    r = (redirects.where(F.col("from_url").isNotNull() & F.col("to_url").isNotNull() & (F.col("from_url") != F.col("to_url")))
         .groupBy("from_url").agg(F.min("to_url").alias("to_url")))
    r = materialize(r)
    more = r.select(F.col("from_url").alias("to_url"), F.lit(True).alias("_more"))
    r = materialize(r.join(more, "to_url", "left").select("from_url", "to_url", F.col("_more").isNull().alias("ended")))
    left = r.where("not ended").count()
    while left:
        ahead = r.select(F.col("from_url").alias("_at"), F.col("to_url").alias("_to"), F.col("ended").alias("_ended"))
        going = r.where("not ended").join(ahead, F.col("to_url") == F.col("_at"))
        going = going.select("from_url", F.col("_to").alias("to_url"), F.col("_ended").alias("ended"))
        r = materialize(r.where("ended").unionByName(going))
        left, before = r.where("not ended").count(), left
        if left == before:
            break
    return r.where("ended").select("from_url", "to_url")


def resolve_redirects(stubs: DataFrame, redirects: DataFrame, url: str = "url",
                      marker: str = WRAPPED_MARKER) -> DataFrame:
    """Wrapped URLs replaced by the end of their chain of captured redirects; unknown ones, those in a
    ring of redirects and unwrapped ones kept."""
    r = redirect_ends(redirects).select(F.col("from_url").alias("_from"), F.col("to_url").alias("_to"))
    wrapped = F.col(url).contains(marker)
    d = stubs.join(r, wrapped & (F.col(url) == F.col("_from")), "left")
    return d.withColumn(url, F.when(wrapped, F.coalesce(F.col("_to"), F.col(url))).otherwise(F.col(url))) \
            .drop("_from", "_to")
