"""Run commits: a run cut off after any table write, run again, equals an undisturbed one."""

import pytest
from pyspark.sql import functions as F

from pressroom.operators import runstore as R
from pressroom.plans.commands import run_collect, run_dry, run_fetch, run_repair
from pressroom.sources.outlets import outlets_df, select_outlets

BODY = "<p>" + "A sentence that is long enough to be a paragraph of its own here. " * 4 + "</p>"
TS = "2026-01-02 03:04:05"


def page(title):
    return f"<html><head><title>{title} - Site</title></head><body>{BODY * 4}</body></html>"


@pytest.fixture(scope="module")
def inputs(spark):
    pages = spark.createDataFrame([(f"https://x/{i}", page(f"T{i}") if i != 3 else "") for i in range(8)], "url string, html string")
    stub = "run_id string, outlet_key string, page_no int, stub_ord long, url string, title string, date string"
    first = spark.createDataFrame([("r", "conjur", 1, i, f"https://x/{i}", "", "") for i in (1, 2, 3)]
                                  + [("r", "estadao", 1, i, f"https://x/{i}", "", "2026-01-01") for i in (2, 4)], stub)
    second = spark.createDataFrame([("r", "estadao", 1, i, f"https://x/{i}", "", "") for i in (1, 5, 6)], stub)
    return pages, first, second, select_outlets(outlets_df(spark), "conjur,estadao")


def contents(spark, base):
    out = {}
    for t in R.TABLES:
        df = R.read(spark, base, t).drop("seq")
        out[t] = sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    out["text"] = sorted(map(tuple, R.read_texts(spark, base).collect()))
    return out


def literal(spark, run, first, n):
    """The four tables of a run of ``n`` articles, without a collect."""
    rows = [(first + i, "2026-01-01", "o", f"t{i}", f"https://{run}/{i}", "", "s", "no") for i in range(n)]
    articles = spark.createDataFrame(rows, "row_num long, date string, outlet string, title string, url string, theme string, summary string, paywalled string")
    texts = articles.where("row_num % 2 = 1").selectExpr("row_num", "concat('text of ', url) text")
    results = spark.createDataFrame([("o", 1, n + 1, n, n, "", 1)], "outlet string, pages long, hits long, new long, added long, note string, sel_ord int")
    return {"articles": articles, "texts": texts, "outlet_results": results, "runs": R.audit_row(spark, run, "", TS)}


def test_cut_off_runs_are_completed(spark, tmp_path):
    """Two runs, each cut off after 0, 1 ... 4 tables and then written whole."""
    good, base = str(tmp_path / "good"), str(tmp_path / "hurt")
    for b in (good, base):
        R.create(spark, b)
    for k, (run, n) in enumerate((("one", 3), ("two", 4))):
        since, last = R.position(spark, good)
        tables = literal(spark, run, last + 1, n)
        assert R.write_run(spark, good, run, since, **tables)
        for stop in range(len(R.TABLES) + 1):
            attempt = R.begin_attempt()
            for name in list(R.TABLES)[:stop]:
                R.write_table(tables[name], base, name, run, attempt)
            assert R.position(spark, base) == (since, last)      # nothing of it is seen
        assert R.write_run(spark, base, run, since, **tables)
        assert not R.write_run(spark, base, run, since, **tables)
    want = contents(spark, good)
    assert len(want["articles"]) == 7 and len(want["text"]) == 4 and contents(spark, base) == want
    assert R.remove_unfinished(spark, base) == 8 and contents(spark, base) == want
    assert "dynamicpruning" in R.read(spark, base, "articles")._jdf.queryExecution().executedPlan().toString()


def test_cut_off_collect(spark, tmp_path, inputs, monkeypatch):
    pages, first, second, sel = inputs
    good, base = str(tmp_path / "good"), str(tmp_path / "hurt")
    for b in (good, base):
        R.import_run(spark, b, literal(spark, "x", 1, 0)["articles"].unionByName(literal(spark, "old", 1, 2)["articles"]))
    assert run_collect(good, "one", first, pages, sel, "q", ts=TS, with_dom=False)
    with monkeypatch.context() as m:
        def stop(*a, **k):
            raise KeyboardInterrupt

        m.setattr(R, "commit", stop)
        with pytest.raises(KeyboardInterrupt):
            run_collect(base, "one", first, pages, sel, "q", ts=TS, with_dom=False)
    assert run_collect(base, "one", first, pages, sel, "q", ts=TS, with_dom=False)
    assert not run_collect(base, "one", first, pages, sel, "q", ts=TS, with_dom=False)
    assert contents(spark, base) == contents(spark, good)
    assert sorted((r.row_num, r.url) for r in R.read(spark, base, "articles").where("run_id = 'one'").collect()) == [
        (3, "https://x/1"), (4, "https://x/2"), (5, "https://x/4")]
    res = {r.outlet: (r.hits, r.new, r.added) for r in R.read(spark, base, "outlet_results").collect()}
    assert sorted(res.values()) == [(2, 1, 1), (3, 3, 2)]


def test_dry_run_is_audited(spark, tmp_path, inputs):
    pages, first, second, sel = inputs
    base = str(tmp_path / "s")
    R.import_run(spark, base, spark.createDataFrame([(1, "https://x/2")], "row_num long, url string"))
    assert sorted(r.url[-1] for r in run_dry(base, "d", first, sel, "q").collect()) == ["1", "3", "4"]
    assert sorted((r.hits, r.new, r.added) for r in R.read(spark, base, "outlet_results").collect()) == [(2, 1, 0), (3, 2, 0)]
    assert R.read(spark, base, "runs").count() == 1 and R.read(spark, base, "articles").count() == 1


def test_empty_store_moved_store_and_double_commit(spark, tmp_path):
    base = str(tmp_path / "s")
    R.create(spark, base)
    assert R.position(spark, base) == (0, 0) and R.read(spark, base, "articles").count() == 0
    art = spark.createDataFrame([(1, "u1")], "row_num long, url string")
    a, b = R.begin_attempt(), R.begin_attempt()
    assert a < b
    for run, attempt in (("x", a), ("y", b)):
        R.write_table(art, base, "articles", run, attempt)
    assert R.commit(spark, base, "x", a, 0)
    assert not R.commit(spark, base, "x", a, 1)
    with pytest.raises(R.StoreMoved):
        R.commit(spark, base, "y", b, 0)                       # numbered before x was committed
    assert [(r.row_num, r.url, r.run_id) for r in R.read(spark, base, "articles").collect()] == [(1, "u1", "x")]
    # two attempts of a run that both reach the manifest: the first stands
    spark.createDataFrame([("x", b, "collect", 1, 9)], R.MANIFEST).write.mode("append").parquet(f"{base}/manifest")
    assert R.position(spark, base) == (1, 1)


def test_fetch_and_repair_are_runs(spark, tmp_path, inputs):
    pages, *_ = inputs
    base = str(tmp_path / "s")
    have = spark.createDataFrame([(1, "https://x/1", "no"), (2, "https://x/2", "yes"), (3, "https://x/3", "no"), (4, "https://x/4", "no")],
                                 "row_num long, url string, paywalled string")
    R.import_run(spark, base, have, spark.createDataFrame([(1, "first"), (2, "second")], "row_num long, text string"))
    urls = spark.createDataFrame([(0, k, f" https://x/{i}/ ") for k, i in enumerate((7, 1, 0, 3))], "src_ord int, line_no long, url string")
    assert run_fetch(base, "f", urls, pages, with_dom=False)
    assert not run_fetch(base, "f", urls, pages, with_dom=False)
    assert {r.row_num: r.url for r in R.read(spark, base, "articles").where("run_id = 'f'").collect()} == {5: "https://x/7", 6: "https://x/0"}
    assert R.read(spark, base, "runs").count() == 0            # fetch leaves no audit record
    assert {r.status: r.n for r in run_repair(base, "m1", pages, with_dom=False).collect()} == {"skipped": 4, "failed": 1, "fetched": 1}
    assert run_repair(base, "m1", pages, with_dom=False) is None
    new = pages.withColumn("html", F.replace("html", F.lit("own"), F.lit("very own")))
    run_repair(base, "m2", new, overwrite=True, with_dom=False)
    texts = {r.row_num: r.text for r in R.read_texts(spark, base).collect()}
    assert sorted(texts) == [1, 2, 4, 5, 6] and texts[2] == "second"          # paywalled rows stay as they are
    assert all("very own" in texts[i] for i in (1, 4, 5, 6))
    assert R.position(spark, base) == (4, 6)
