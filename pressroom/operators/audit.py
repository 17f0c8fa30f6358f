"""Run audit: per-outlet counters (A1-A4) and the markdown rendering.

A run has one line per selected outlet, so the per-run list that is
collected for rendering is bounded by the size of the outlet registry,
not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def py_repr(c) -> Column:
    """Python ``repr`` of a printable string: single quotes, or double quotes
    when the text holds a single quote and no double quote."""
    s = F.col(c) if isinstance(c, str) else c
    esc = s
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    dq = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def outlet_line(outlet="outlet", hits="hits", new="new", added="added", pages="pages", note="note") -> Column:
    base = F.format_string("- **%s**: %d hits, %d new, %d added (pages: %d)",
                           F.col(outlet), F.col(hits), F.col(new), F.col(added), F.col(pages))
    return F.when(F.coalesce(F.col(note), F.lit("")) != "",
                  F.concat(base, F.lit(" — "), F.col(note))).otherwise(base)


def totals(outlet_results: DataFrame) -> DataFrame:
    """A4: total added per run, plus the per-outlet rows, in one rollup pass."""
    return (outlet_results.rollup("run_id", "outlet")
            .agg(F.sum("hits").alias("hits"), F.sum("new").alias("new"), F.sum("added").alias("added"))
            .where(F.col("run_id").isNotNull()))


def render(runs: DataFrame, outlet_results: DataFrame) -> DataFrame:
    """One markdown block per run (run_id, block).

    ``runs``: run_id, ts, query, project_context.  ``outlet_results``: run_id,
    outlet, sel_ord, pages, hits, new, added, note (sel_ord = line order).
    """
    lines = (outlet_results.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("sel_ord", outlet_line().alias("line")))).alias("_l"),
        F.sum("added").alias("_total")))
    r = runs.join(lines, "run_id", "left")
    header = F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" — query: "),
                      py_repr("query"))
    ctx = F.when(F.coalesce(F.col("project_context"), F.lit("")) != "",
                 F.concat(F.lit("- _context: "), F.col("project_context"), F.lit("_")))
    body = F.when(F.col("_l").isNotNull(), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
    total = F.format_string("- **total added: %d**", F.coalesce(F.col("_total"), F.lit(0)).cast("long"))
    parts = F.array_compact(F.array(header, ctx, body, total, F.lit("")))
    return r.select("run_id", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("block"))


def repair_status(paywalled, has_text, url, new_text, overwrite: bool = False) -> Column:
    """A5: status of one stored row in a text repair, in the reference's order."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    st = F.when(col(paywalled) == "yes", F.lit("skipped"))
    if not overwrite:
        st = st.when(col(has_text), F.lit("skipped"))
    return (st.when(F.coalesce(col(url), F.lit("")) == "", F.lit("failed"))
            .when(F.coalesce(col(new_text), F.lit("")) != "", F.lit("fetched"))
            .otherwise(F.lit("failed")))
