"""collect: discovered stubs -> new, extracted, deduplicated, numbered articles + audit counts.

The reference walks outlets in order, fetches every unseen stub and appends
the first successful extraction of each URL.  Here that loop is three
set-at-a-time facts per stub, all from aggregates on ``url`` (partial
aggregation, so a URL carrying a third of all stubs is pre-combined before
the shuffle) joined back:

* ``in_store``   - URL already in the store (J1 as a left join on the distinct known set)
* winner         - the first ``ok`` extraction in (outlet order, page, stub) order (W2)
* ``is_new``     - not in store and not stored by an earlier outlet of this run (A2)

Extraction runs once per distinct (url, lane), not once per stub.  The three facts are decided on narrow
rows, written once; text and summary are joined to the winners alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.functions import text as T
from pressroom.operators import lanes as LN
from pressroom.operators.numbering import number_rows
from pressroom.operators.store import mark_known
from pressroom.schemas import ARTICLE_FIELDS
from pressroom.session import materialize

#: Order of stubs: outlet turn, page, captured body, place in it.
ORDER = ["sel_ord", "page_no", "feed", "stub_ord"]


@dataclass
class CollectResult:
    articles: DataFrame       # row_num + stories columns
    texts: DataFrame          # row_num, text
    outlet_results: DataFrame  # run_id, outlet, pages, hits, new, added, note
    stubs: DataFrame          # every stub with in_store / ok / is_new / is_winner (no text)


def attach_outlets(stubs: DataFrame, selected: DataFrame) -> DataFrame:
    """Stubs of the selected outlets, with the outlet's order, name, lane and gate."""
    dim = selected.select(F.col("key").alias("outlet_key"), "sel_ord", F.col("name").alias("outlet_name"),
                          "lane", "min_chars")
    if "feed" not in stubs.columns:
        stubs = stubs.withColumn("feed", F.lit(""))
    return stubs.join(F.broadcast(dim), "outlet_key")


def wanted_pages(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, html) of the wanted URLs, one capture of each: the one with the smallest ``page_id`` (by a
    hash of the page where captures have no id; of captures that share an id, the least page).  The
    choice is an aggregate of ids; ``html`` is read for the chosen captures only, and meets their URL once."""
    urls = keys.select("url").distinct()
    cap = pages if "page_id" in pages.columns else pages.withColumn("page_id", F.xxhash64("html"))
    cap = cap.select("url", "page_id", "html").where(F.col("url").isNotNull())
    first = cap.join(urls, "url", "left_semi").groupBy("url").agg(F.min("page_id").alias("_first"))
    # "not above the smallest" is "equal to it", and leaves the join keyed by URL alone, as the group is
    chosen = cap.join(first, "url").where(F.col("_first").isNull() | (F.col("page_id") <= F.col("_first")))
    return chosen.groupBy("url").agg(F.min("html").alias("html"))


def extract_pages(keys: DataFrame, pages: DataFrame, with_dom: bool = True) -> DataFrame:
    """(url, lane, min_chars) -> lane columns; a missing page is a failed fetch.

    Regex lanes run as one projection; DOM lanes (a Python parser) only see
    the rows routed to them, and only when ``with_dom``.  ``keys`` may have a column ``first``, in whose order the
    keys of a URL are asked: of its DOM lanes, then only the first ``ok`` one has a text and a summary.
    """
    cols = ["url", "lane", "min_chars", "title", "date", "text", "summary", "ok"]
    # one page lookup for all lanes of a URL (the list is bounded by the number of lanes)
    asked = [c for c in ("lane", "min_chars", "first") if c in keys.columns]
    lanes = keys.groupBy("url").agg(F.collect_set(F.struct(*asked)).alias("_lanes"))
    d = lanes.join(wanted_pages(keys, pages), "url", "left").fillna({"html": ""})
    each = lambda x: x.withColumn("_l", F.explode("_lanes")).withColumn("lane", F.col("_l.lane")).withColumn(
        "min_chars", F.col("_l.min_chars")).drop("_l", "_lanes")
    of = lambda names: F.filter("_lanes", lambda x: x["lane"].isin(*names))
    regex = each(d.withColumn("_lanes", of(LN.REGEX_LANES)) if with_dom else d)
    out = LN.regex_dispatch(regex, "lane", "html", "url", "min_chars")
    out = out.withColumn("ok", F.col("ok") & (F.col("html") != "")).select(*cols)
    if with_dom:
        from pressroom.operators.domlanes import DEFAULT_RULES, dom_each
        from pressroom.operators.htmlblocks import html_page
        # each page is parsed once, whatever number of DOM lanes asks for it
        dom = d.withColumn("_lanes", of(LN.DOM_LANES)).where(F.size("_lanes") > 0)
        dom = dom.withColumn("_pg", html_page(F.col("html"), DEFAULT_RULES))
        out = out.unionByName(dom_each(dom).select(*cols))
    return out


def collect(stubs: DataFrame, pages: DataFrame, selected: DataFrame, store: DataFrame,
            run_id: str = "run", max_pages: int = 1, notes: DataFrame | None = None,
            base: int | None = None, with_dom: bool = True) -> CollectResult:
    s = attach_outlets(stubs, selected)
    s = mark_known(s, store)

    # a URL's winner is the ok lane whose stub comes first: of its lanes, the text of that one is stored and moved
    order = F.struct(*[F.col(k) for k in ORDER])
    keys = s.where(~F.col("in_store")).groupBy("url", "lane", "min_chars").agg(F.min(order).alias("first"))
    # The extraction is the costly step and feeds both the winner aggregate and
    # the rows joined back to it: computed once, written to the checkpoint folder.
    ex = materialize(extract_pages(keys, pages, with_dom))
    # what decides is narrow: text and summary join the winners only
    facts = ex.select("url", "lane", "min_chars", F.col("title").alias("x_title"), F.col("date").alias("x_date"), "ok")
    c = s.join(facts, ["url", "lane", "min_chars"], "left")
    c = c.withColumn("ok", F.coalesce(F.col("ok"), F.lit(False)) & ~F.col("in_store"))
    # Extracted title / date fall back to the stub's
    c = (c.withColumn("a_title", T.first_nonempty(F.col("x_title"), F.col("title")))
          .withColumn("a_date", T.first_nonempty(F.col("x_date"), F.col("date"))))

    first_ok = (c.where("ok").groupBy("url").agg(F.min(order).alias("w")))
    c = (c.join(first_ok, "url", "left")
          .withColumn("is_winner", F.col("ok") & (order == F.col("w")))
          .withColumn("is_new", ~F.col("in_store")
                      & (F.col("w").isNull() | (F.col("w.sel_ord") >= F.col("sel_ord"))))
          .drop("w"))
    c = materialize(c)      # articles, texts, counts and stubs read the same decisions

    if base is None:   # A10 as a scalar subquery of the numbering plan
        base = store.agg(F.coalesce(F.max("row_num"), F.lit(0)) + 1).scalar()
    # only the order keys are numbered; a URL has one winner, which gets its number back by its URL
    numbers = number_rows(c.where("is_winner").select(*ORDER, "url").distinct(), ORDER, base=base).select("url", "row_num")
    bodies = ex.where("ok and text is not null").select("url", "lane", "min_chars", "text", "summary")
    numbered = c.where("is_winner").dropDuplicates(["url"]).join(numbers, "url").join(bodies, ["url", "lane", "min_chars"])
    articles = numbered.select(
        "row_num", F.col("a_date").alias("date"), F.col("outlet_name").alias("outlet"),
        F.col("a_title").alias("title"), "url", F.lit("").alias("theme"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.lit("no").alias("paywalled"))
    texts = numbered.where(F.col("text") != "").select("row_num", "text")

    counts = c.groupBy("outlet_key", "sel_ord").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if("is_new").alias("new"),
        F.count_if("is_winner").alias("added"))
    sel = selected.select(F.col("key").alias("outlet_key"), "sel_ord", F.col("name").alias("outlet"))
    res = sel.join(counts, ["outlet_key", "sel_ord"], "left")
    if notes is not None:
        res = res.join(notes.select("outlet_key", "note"), "outlet_key", "left")
    else:
        res = res.withColumn("note", F.lit(None).cast("string"))
    res = res.select(
        F.lit(run_id).alias("run_id"), "outlet", "sel_ord",
        F.lit(max_pages).cast("long").alias("pages"),
        *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in ("hits", "new", "added")],
        F.coalesce("note", F.lit("")).alias("note"))
    return CollectResult(articles.select("row_num", *ARTICLE_FIELDS), texts, res, c)


def dry_run(stubs: DataFrame, store: DataFrame) -> DataFrame:
    """new candidates only, date or '?', title cut to 80 characters."""
    from pressroom.operators.store import novelty

    new = novelty(stubs, store)
    return new.select("outlet_key", "url",
                      F.when(F.col("date") != "", F.col("date")).otherwise(F.lit("?")).alias("date"),
                      F.substring(F.coalesce("title", F.lit("")), 1, 80).alias("title"))
