"""Extraction lanes: page HTML -> title, date, text, summary, ok.

Regex lanes are built-in expressions:

* ``generic`` (X17): readable text of the whole page (X9), gate 200, summary
  = first 300 characters, no title / date;
* ``meta`` (X1-X4, X9, L4): og:title or the cut <title>, three date
  patterns, readable text, gate from the outlet, long-line summary;
* ``paragraph`` (X8, L3, X14): <p> bodies over 50 chars, at least three,
  middle slice, joined by blank lines, summary = first two joined.

DOM lanes (folha, globo, piaui) sit on the block table of
:mod:`pressroom.operators.htmlblocks`.  :func:`regex_dispatch` picks the lane
per row on the ``lane`` column (X18) in one projection; DOM lanes run only
over the rows routed to them (:func:`pressroom.plans.collect.extract_pages`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.functions import text as T

REGEX_LANES = ("generic", "meta", "paragraph")
DOM_LANES = ("folha", "globo", "piaui")


def apply_lane(df: DataFrame, lane: str, html: str = "html", url: str = "url",
               min_chars: int | None = None) -> DataFrame:
    """One regex lane for every row; the literal lane folds the dispatch away."""
    default = {"generic": 200, "meta": 300, "paragraph": 200}[lane]
    d = df.withColumn("_lane", F.lit(lane)).withColumn("_min", F.lit(default if min_chars is None else min_chars))
    return regex_dispatch(d, "_lane", html, url, "_min").drop("_lane", "_min")


def regex_dispatch(df: DataFrame, lane: str = "lane", html: str = "html", url: str = "url",
                   min_chars: str = "min_chars") -> DataFrame:
    """X18 for regex lanes: each row evaluates only its own lane.

    The paragraph array and the text are materialised once as columns (the
    optimizer keeps a costly expression referenced twice in its own
    projection instead of copying it).
    """
    h, u, ln, mc = F.col(html), F.col(url), F.col(lane), F.col(min_chars)
    d = df.withColumn("_ps", F.when(ln == "paragraph", T.paragraphs(h)))
    d = d.withColumn("_body", T.body_slice(F.col("_ps")))
    d = d.withColumn("text", F.when(ln == "paragraph", F.array_join(F.col("_body"), "\n\n"))
                     .when(ln.isin("meta", "generic"), T.html_to_text(h)))
    t, body = F.col("text"), F.col("_body")
    title = (F.when(ln == "meta", T.first_nonempty(T.meta_property(h, "og:title"), T.title_tag(h, (" - ", " | "))))
             .when(ln == "paragraph", T.first_nonempty(T.meta_property(h, "og:title"), T.title_tag(h, (" - ",))))
             .otherwise(F.lit("")))
    date = (F.when(ln == "meta", T.page_date(h, with_time_tag=True))
            .when(ln == "paragraph", T.page_date(h, with_time_tag=False))
            .otherwise(F.lit("")))
    summary = (F.when(ln == "meta", T.lines_summary(t))
               .when(ln == "paragraph", F.substring(F.array_join(F.slice(body, 1, 2), " "), 1, 300))
               .when(ln == "generic", F.substring(t, 1, 300)))
    ok = (F.when(ln == "paragraph", (F.size(F.col("_ps")) >= 3) & (F.length(t) >= mc))
          .when(ln.isin("meta", "generic"), F.length(t) >= mc)
          .otherwise(F.lit(False)))
    return (d.select("*", title.alias("title"), date.alias("date"), summary.alias("summary"),
                     F.coalesce(ok, F.lit(False)).alias("ok"))
            .drop("_ps", "_body"))
