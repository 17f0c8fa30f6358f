"""The three commands over a run store: collect, fetch and refetch-texts, each one committed run.

Each reads the committed store (never its own unfinished rows), computes its rows, writes them under
a fresh attempt and commits.  Cut off anywhere, the same call again gives what an undisturbed
call gives; called again after its commit, it does nothing and returns False.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.operators import runstore as R
from pressroom.operators.store import mark_known
from pressroom.plans.collect import attach_outlets, collect, dry_run
from pressroom.plans.repair import DEFAULT_LANES, fetch_urls, repair_texts


def run_collect(base: str, run_id: str, stubs: DataFrame, pages: DataFrame, selected: DataFrame, query: str = "",
                project_context: str = "", ts=None, max_pages: int = 1, notes: DataFrame | None = None,
                with_dom: bool = True) -> bool:
    """collect: articles, texts and the audit records of one run."""
    spark = stubs.sparkSession
    R.create(spark, base)
    if R.is_committed(spark, base, run_id):
        return False
    since, last = R.position(spark, base)
    known = R.read(spark, base, "articles").select("row_num", "url")
    res = collect(stubs, pages, selected, known, run_id, max_pages, notes, base=last + 1, with_dom=with_dom)
    return R.write_run(spark, base, run_id, since, articles=res.articles, texts=res.texts, outlet_results=res.outlet_results,
                       runs=R.audit_row(spark, query, project_context, ts))


def run_dry(base: str, run_id: str, stubs: DataFrame, selected: DataFrame, query: str = "", project_context: str = "",
            ts=None, max_pages: int = 1) -> DataFrame:
    """the candidates that collect would fetch; only the audit records of the run are written."""
    spark = stubs.sparkSession
    R.create(spark, base)
    since, _ = R.position(spark, base)
    known = R.read(spark, base, "articles").select("row_num", "url")
    s = mark_known(attach_outlets(stubs, selected), known)
    n = s.groupBy("outlet_key", "sel_ord").agg(F.count("*").alias("hits"), F.count_if(~F.col("in_store")).alias("new"))
    res = selected.select(F.col("key").alias("outlet_key"), "sel_ord", F.col("name").alias("outlet")).join(n, ["outlet_key", "sel_ord"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    res = res.select("outlet", "sel_ord", F.lit(max_pages).cast("long").alias("pages"), count("hits"), count("new"),
                     F.lit(0).cast("long").alias("added"), F.lit("").alias("note"))
    R.write_run(spark, base, run_id, since, "dry", outlet_results=res, runs=R.audit_row(spark, query, project_context, ts))
    return dry_run(stubs, known)


def run_fetch(base: str, run_id: str, urls: DataFrame, pages: DataFrame, registry: Sequence[tuple] = DEFAULT_LANES,
              hint: str | None = None, normalize: bool = False, with_dom: bool = True,
              order: Sequence[str] = ("src_ord", "line_no")) -> bool:
    """fetch: articles and texts of a URL list; no audit record, as fetch writes none."""
    spark = urls.sparkSession
    R.create(spark, base)
    if R.is_committed(spark, base, run_id):
        return False
    since, last = R.position(spark, base)
    known = R.read(spark, base, "articles").select("row_num", "url")
    new = fetch_urls(urls, known, pages, registry, hint, normalize, with_dom, base=last + 1, order=order)
    return R.write_run(spark, base, run_id, since, "fetch", articles=new, texts=new.where("text <> ''").select("row_num", "text"))


def run_repair(base: str, run_id: str, pages: DataFrame, registry: Sequence[tuple] = DEFAULT_LANES, overwrite: bool = False,
               with_dom: bool = True) -> DataFrame | None:
    """refetch-texts: texts for stored rows that lack one (all rows with ``overwrite``); the articles'
    columns stay.  Returns the counts by status, None if the run is committed already."""
    spark = pages.sparkSession
    R.create(spark, base)
    if R.is_committed(spark, base, run_id):
        return None
    since, _ = R.position(spark, base)
    rows, counts = repair_texts(R.read(spark, base, "articles"), R.read_texts(spark, base), pages, registry, overwrite, with_dom)
    R.write_run(spark, base, run_id, since, "repair", texts=rows.where(F.col("status") == "fetched").select("row_num", "text"))
    return counts
