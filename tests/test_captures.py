"""Stored captures: no exchange of HTML from a bucketed page table; years as partitions."""

from pyspark.sql import functions as F

from pressroom.plans.collect import extract_pages, wanted_pages
from pressroom.plans.discover import search
from pressroom.sources.captures import read_bodies, read_index, write_bodies, write_index, write_pages


def exchanged(df):
    """Names of the columns that some exchange of the physical plan carries."""
    out = set()

    def walk(node):
        if node.nodeName() == "Exchange":
            out.update(node.output().apply(i).name() for i in range(node.output().size()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_page_lookup_moves_no_html(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://x/{i % 40}", f"<p>{i}</p>") for i in range(60)], "page_id long, url string, html string")
    keys = spark.createDataFrame([(f"https://x/{i}", "generic", 1) for i in range(0, 80, 2)], "url string, lane string, min_chars int")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in names}
    try:
        table = write_pages(pages, "test_captured_pages", 8, str(tmp_path / "pages"))
        for k, v in zip(names, ("false", "-1")):
            spark.conf.set(k, v)
        got = wanted_pages(keys, table)
        assert "html" not in exchanged(got) and "html" in exchanged(wanted_pages(keys, pages.repartition(3)))
        assert "html" not in exchanged(extract_pages(keys, table, with_dom=False))
        assert {r.url: r.html for r in got.collect()} == {f"https://x/{i}": f"<p>{i}</p>" for i in range(0, 40, 2)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("drop table if exists test_captured_pages")


def test_captures_that_share_an_id(spark):
    pages = spark.createDataFrame([(1, "u", "b"), (1, "u", "a"), (1, "u", "a"), (2, "u", "0"), (None, "v", "x"), (None, "w", None), (3, None, "n")],
                                  "page_id long, url string, html string")
    keys = spark.createDataFrame([("u",), ("v",), ("w",), ("z",)], "url string")
    assert {r.url: r.html for r in wanted_pages(keys, pages).collect()} == {"u": "a", "v": "x", "w": None}


def test_years_are_partitions(spark, tmp_path):
    host = "https://oglobo.globo.com/sitemap/oglobo"
    rows = [(f"{host}/{y}/01/02_1.xml", "globo", "sitemap", 1, f"<loc>https://oglobo.globo.com/venda-{y}</loc>") for y in range(2018, 2027)]
    rows += [("idx", "globo", "sitemap_index", 1, "".join(f"<loc>{r[0]}</loc>" for r in rows))]
    feeds = spark.createDataFrame(rows, "feed_id string, outlet_key string, kind string, page_no int, xml string")
    write_bodies(feeds, str(tmp_path / "bodies"))
    stored = read_bodies(spark, str(tmp_path / "bodies"))
    assert stored.count() == 10
    got = search(stored, "globo", "venda", max_pages=2, year=2026)
    assert sorted(r.url for r in got.collect()) == ["https://oglobo.globo.com/venda-2025", "https://oglobo.globo.com/venda-2026"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1]
    write_index(feeds.where("kind = 'sitemap'").select("feed_id", F.regexp_extract("feed_id", "/([0-9]{4})/", 1).cast("int").alias("year")), str(tmp_path / "index"))
    some = read_index(spark, str(tmp_path / "index"), 2019, 2020)
    assert sorted(r.year for r in some.collect()) == [2019, 2020]
    assert len(some.inputFiles()) == 2 or "year" in some._jdf.queryExecution().executedPlan().toString()
