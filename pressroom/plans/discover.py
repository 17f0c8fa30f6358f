"""Discovery over captured bodies -> one stub table (the search step of collect).

``feeds`` holds the captured bodies: ``feed_id, outlet_key, kind, page_no, xml`` with ``kind``
one of ``rss``, ``topic``, ``sitemap_index``, ``sitemap`` (``feed_id`` = its URL), ``results``; read back
from :func:`captures.read_bodies` they have a ``year`` too, which prunes dated sitemaps.
How an outlet is searched is data: the rows of the search-rule table
(:data:`pressroom.sources.outlets.SEARCH_ROWS`) are compiled here to a union of source operators (S4-S10)
with the keyword filters (F1-F7) and the order rules (W1, W4, W5) that the rows name.  No outlet has code of
its own: another outlet is another row.  :func:`search_all` unions the selected outlets' stubs (N1) and
notes outlets with nothing captured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pressroom.functions import text as T
from pressroom.operators.discovery import first_seen, page_window, stop_at_empty
from pressroom.operators.domlanes import DEFAULT_RULES, result_items
from pressroom.operators.selectors import RuleSet
from pressroom.sources import feeds as S
from pressroom.sources.outlets import OUTLET_ROWS, search_rules_df

STUB_COLS = ["outlet_key", "page_no", "feed", "stub_ord", "url", "title", "date"]
DOMAIN = {k: d for k, _n, d, *_ in OUTLET_ROWS}
BODY = ["feed_id", "page_no"]


def _rss(d: DataFrame, r: Row, kws, max_pages: int, rules: RuleSet) -> DataFrame:
    n = r["per_page"] * max_pages if r["per_page"] else None
    return S.rss_items(d, max_items=n, site=r["domain"]).withColumnRenamed("item_pos", "pos")


def _rss_strict(d: DataFrame, r: Row, kws, max_pages: int, rules: RuleSet) -> DataFrame:
    return S.rss_strict(d, kws, exclude=r["exclude"].split()).withColumnRenamed("item_pos", "pos")


def _link(d: DataFrame, r: Row, kws, max_pages: int, rules: RuleSet) -> DataFrame:
    return S.section_links(d.withColumnRenamed("xml", "html"), r["sections"].split(), r["base"], r["domain"]).withColumnRenamed("a_pos", "pos")


def _href(d: DataFrame, r: Row, kws, max_pages: int, rules: RuleSet) -> DataFrame:
    return S.topic_links(d.withColumnRenamed("xml", "html"), pattern=r["pattern"]).withColumnRenamed("link_pos", "pos")


def _loc(d: DataFrame, r: Row, kws, max_pages: int, rules: RuleSet) -> DataFrame:
    return S.sitemap_urls(d, pattern=r["pattern"]).withColumnRenamed("loc_pos", "pos")


def _result(d: DataFrame, r: Row, kws, max_pages: int, rules: RuleSet) -> DataFrame:
    return result_items(d.withColumnRenamed("xml", "html"), rules=rules, outlet=r["outlet"], domain=r["domain"]).withColumnRenamed("item_pos", "pos")


#: How a kind of item is read out of a body; all give pos and url, some title and date.
ITEMS = {"rss": _rss, "rss_strict": _rss_strict, "link": _link, "href": _href, "loc": _loc, "result": _result}


def _source(feeds: DataFrame, r: Row, query: str, max_pages: int, year: int, redirects: DataFrame | None, rules: RuleSet) -> DataFrame:
    """The items of one rule row: page_no, feed, stub_ord, url, title, date."""
    flags, kws = set(r["flags"].split()), T.query_tokens(F.lit(query))
    mine = feeds.where(F.col("outlet_key") == r["outlet"])
    bodies = mine.where(F.col("kind") == r["kind"])
    if "years" in flags and "year" in feeds.columns:     # bodies stored by year: other years are not opened
        bodies = bodies.where(F.col("year").between(year - max(0, max_pages - 1), year))
    bodies = bodies.select(*BODY, "xml")
    if "paged" in flags:
        bodies = page_window(bodies, max_pages)
    if "years" in flags:
        index = S.sitemap_index(mine.where(F.col("kind") == "sitemap_index").select("xml"), year_from=year - max(0, max_pages - 1), year_to=year)
        bodies = bodies.join(index.select(F.col("loc").alias("feed_id")).distinct(), "feed_id", "left_semi")
    if r["keywords"]:
        bodies = bodies.where(F.size(kws) > 0)           # a query without a usable token finds nothing
    items = ITEMS[r["item"]](bodies, r, kws, max_pages, rules)
    if "wrapped" in flags and redirects is not None:
        items = S.resolve_redirects(items, redirects)
    if r["domain"]:
        items = items.where(F.col("url").contains(r["domain"]))
    if r["keywords"] == "url":
        items = items.where(T.any_keyword(F.lower("url"), kws))
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if "labelled" in flags and c in items.columns else F.lit("")).alias(c)
    page = F.col("page_no") if "paged" in flags else F.lit(r["src"])
    return items.select(page.cast("int").alias("page_no"), F.col("feed_id").cast("string").alias("feed"),
                        F.col("pos").cast("long").alias("stub_ord"), "url", text("title"), text("date"))


def search(feeds: DataFrame, key: str, query: str, max_pages: int = 1, year: int = 2026, redirects: DataFrame | None = None,
           search_rules: Sequence[Row] | None = None, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The search of one outlet, compiled from its rule rows."""
    table = search_rules if search_rules is not None else search_rules_df(feeds.sparkSession).collect()      # a few rows an outlet
    rows = sorted((r for r in table if r["outlet"] == key), key=lambda r: r["src"])
    if not rows:
        raise KeyError(f"no search rule for outlet {key!r}")
    flags = set(rows[0]["flags"].split())
    out = None
    for r in rows:
        part = _source(feeds, r, query, max_pages, year, redirects, rules)
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("outlet_key", F.lit(key))
    if "distinct" in flags:
        out = first_seen(out, ["outlet_key", "url"], ["page_no", "feed", "stub_ord"])
    if "stop" in flags:
        asked = feeds.where((F.col("outlet_key") == key) & (F.col("kind") == rows[0]["kind"])).select("outlet_key", "page_no")
        out = stop_at_empty(out, page_window(asked, max_pages), ["outlet_key"], from_one=True)
    return out.select(*STUB_COLS)


def search_all(feeds: DataFrame, query: str, keys: list[str], max_pages: int = 1, year: int = 2026, redirects: DataFrame | None = None,
               search_rules: DataFrame | None = None, rules: RuleSet = DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """Stubs of the selected outlets, and a note for outlets with nothing captured."""
    spark = feeds.sparkSession
    table = (search_rules if search_rules is not None else search_rules_df(spark)).collect()
    stubs = None
    for k in keys:
        part = search(feeds, k, query, max_pages, year, redirects, table, rules)
        stubs = part if stubs is None else stubs.unionByName(part)
    have = feeds.select("outlet_key").distinct().withColumn("_has", F.lit(True))
    sel = spark.createDataFrame([(k,) for k in keys], "outlet_key string")
    notes = (sel.join(have, "outlet_key", "left").where(F.col("_has").isNull())
             .select("outlet_key", F.lit("search failed: nothing captured").alias("note")))
    return stubs, notes
