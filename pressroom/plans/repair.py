"""refetch-texts and fetch: stored rows / URL lists -> routed extraction.

* :func:`repair_texts` (A5, F9, J6): rows without a text (or all with
  ``overwrite``) and not paywalled are routed (J2) to their lane (X18, the
  generic lane when no outlet matches) and re-extracted; status per row in
  the reference's order, counts by status.  Metadata columns are untouched.
* :func:`fetch_urls` (S11, N4, F14, J1, J2, X17, W3): a URL list is cleaned,
  known URLs dropped, each routed and extracted, the first successful
  occurrence of each URL stored, numbered in list order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.functions import text as T
from pressroom.operators.audit import repair_status
from pressroom.operators.numbering import number_rows
from pressroom.operators.route import route
from pressroom.plans.collect import extract_pages
from pressroom.session import materialize
from pressroom.sources.outlets import GENERIC_MIN_CHARS, OUTLET_ROWS

# (key, domain, lane, min_chars, name) of the default registry
DEFAULT_LANES = [(k, d, lane, m, n) for k, n, d, _s, _q, m, lane in OUTLET_ROWS]


def _lane_cols(url: str, registry: Sequence[tuple], hint=None):
    r = route(url, [(k, d) for k, d, *_ in registry], "first", hint)
    lane_of = F.create_map(*[x for k, _, ln, *_ in registry for x in (F.lit(k), F.lit(ln))])
    min_of = F.create_map(*[x for k, _, _, m, *_ in registry for x in (F.lit(k), F.lit(m))])
    return (r, F.coalesce(F.element_at(lane_of, r), F.lit("generic")),
            F.coalesce(F.element_at(min_of, r), F.lit(GENERIC_MIN_CHARS)))


def repair_texts(articles: DataFrame, texts: DataFrame, pages: DataFrame,
                 registry: Sequence[tuple] = DEFAULT_LANES, overwrite: bool = False,
                 with_dom: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (per-row status with the new text, counts by status)."""
    have = texts.where(F.coalesce(F.col("text"), F.lit("")) != "").select("row_num").distinct() \
        .withColumn("has_text", F.lit(True))
    a = articles.join(have, "row_num", "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))
    todo = (F.col("paywalled") != "yes") & (F.lit(overwrite) | ~F.col("has_text")) & (F.col("url") != "")
    a = a.withColumn("_todo", todo)
    _, lane, min_chars = _lane_cols("url", registry)
    a = a.withColumn("lane", F.when(F.col("_todo"), lane)).withColumn("min_chars", F.when(F.col("_todo"), min_chars))
    keys = a.where("_todo").select("url", "lane", "min_chars").distinct()
    ex = materialize(extract_pages(keys, pages, with_dom)).select("url", "lane", "min_chars",
                                                     F.when(F.col("ok"), F.col("text")).alias("new_text"))
    d = a.join(ex, ["url", "lane", "min_chars"], "left")
    d = d.withColumn("status", repair_status("paywalled", "has_text", "url", "new_text", overwrite))
    rows = d.select("row_num", "url", "status", F.when(F.col("status") == "fetched", F.col("new_text")).alias("text"))
    counts = d.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return rows, counts


def fetch_urls(urls: DataFrame, store: DataFrame, pages: DataFrame,
               registry: Sequence[tuple] = DEFAULT_LANES, hint: str | None = None,
               normalize: bool = False, with_dom: bool = True, base: int | None = None,
               order: Sequence[str] = ("src_ord", "line_no")) -> DataFrame:
    """``urls``: rows with ``url`` and the ``order`` columns (list order) -> new
    article rows, numbered in list order.

    URLs are stripped and lose trailing slashes; the store is compared as it
    is (``normalize=True`` cleans the store side too).  The generic lane
    labels the outlet with the URL's host as written.
    """
    u = urls.withColumn("url", T.url_fetch_clean("url")).where(F.col("url") != "")
    known = store.select(F.col("url").alias("_k")).where(F.col("_k") != "")
    if normalize:
        known = known.select(T.url_fetch_clean("_k").alias("_k"))
    u = u.join(known.distinct(), F.col("url") == F.col("_k"), "left_anti")
    r, lane, min_chars = _lane_cols("url", registry, F.lit(hint) if hint else None)
    names = F.create_map(*[x for k, _d, _l, _m, n in registry for x in (F.lit(k), F.lit(n))])
    u = u.withColumn("okey", r).withColumn("lane", lane).withColumn("min_chars", min_chars)
    ex = materialize(extract_pages(u.select("url", "lane", "min_chars").distinct(), pages, with_dom))
    d = u.join(ex, ["url", "lane", "min_chars"], "left").where(F.coalesce(F.col("ok"), F.lit(False)))
    key = F.struct(*[F.col(c) for c in order])
    firsts = d.groupBy("url").agg(F.min(key).alias("_w"))
    d = d.join(firsts, "url").where(key == F.col("_w")).drop("_w")
    if base is None:   # A10 as a scalar subquery of the numbering plan
        base = store.agg(F.coalesce(F.max("row_num"), F.lit(0)) + 1).scalar()
    n = number_rows(d, list(order), base=base)
    outlet = F.coalesce(F.element_at(names, F.col("okey")), T.url_host("url", lower=False))
    return n.select("row_num", "date", outlet.alias("outlet"), "title", "url", F.lit("").alias("theme"),
                    "summary", F.lit("no").alias("paywalled"), "text")
