"""fetch and refetch-texts as Spark jobs, against the sequential reading of the commands."""

from pyspark.sql import functions as F

from pressroom.plans.repair import fetch_urls, repair_texts

REG = [("k", "known.example", "meta", 300, "Known")]


def _pages(spark):
    long_text = "<p>" + "palavra " * 60 + "</p>"
    return spark.createDataFrame([
        ("https://known.example/a", "<title>A - K</title>" + long_text),
        ("https://Other.example/b", long_text),
        ("https://other.example/short", "<p>tiny</p>"),
    ], "url string, html string")


def test_fetch_urls(spark):
    urls = spark.createDataFrame([
        (0, 1, " https://known.example/a/ "),   # cleaned to .../a, routed to the meta lane
        (0, 2, "https://Other.example/b"),      # generic lane, outlet = host as written
        (0, 3, "https://other.example/short"),  # too short: skipped
        (0, 4, "https://known.example/a"),      # second occurrence of a stored URL
        (0, 5, "https://stored.example/x"),     # already in the store
        (0, 6, "https://missing.example/y"),    # no captured page
    ], "src_ord int, line_no int, url string")
    store = spark.createDataFrame([(7, "https://stored.example/x")], "row_num long, url string")
    out = fetch_urls(urls, store, _pages(spark), registry=REG, with_dom=False)
    got = [(r.row_num, r.outlet, r.url, r.title, r.paywalled) for r in out.orderBy("row_num").collect()]
    assert got == [(8, "Known", "https://known.example/a", "A", "no"),
                   (9, "Other.example", "https://Other.example/b", "", "no")]


def test_fetch_urls_hint(spark):
    urls = spark.createDataFrame([(0, 1, "https://Other.example/b")], "src_ord int, line_no int, url string")
    store = spark.createDataFrame([], "row_num long, url string")
    out = fetch_urls(urls, store, _pages(spark), registry=REG, hint="k", with_dom=False).collect()
    assert [(r.row_num, r.outlet) for r in out] == [(1, "Known")]


def test_repair_texts(spark):
    arts = spark.createDataFrame([
        (1, "https://known.example/a", "no"),       # text missing, page good -> fetched
        (2, "https://Other.example/b", "yes"),      # paywalled -> skipped
        (3, "https://other.example/short", "no"),   # page too short -> failed
        (4, "", "no"),                               # no url -> failed
        (5, "https://Other.example/b", "no"),       # has a text -> skipped
    ], "row_num long, url string, paywalled string")
    texts = spark.createDataFrame([(5, "kept")], "row_num long, text string")
    rows, counts = repair_texts(arts, texts, _pages(spark), registry=REG, with_dom=False)
    st = {r.row_num: r.status for r in rows.collect()}
    assert st == {1: "fetched", 2: "skipped", 3: "failed", 4: "failed", 5: "skipped"}
    assert {r.status: r.n for r in counts.collect()} == {"fetched": 1, "skipped": 2, "failed": 2}
    rows2, _ = repair_texts(arts, texts, _pages(spark), registry=REG, overwrite=True, with_dom=False)
    assert {r.row_num: r.status for r in rows2.collect()}[5] == "fetched"
    fetched = rows.where(F.col("status") == "fetched").first()
    assert fetched.text == "A - K\n\n" + " ".join(["palavra"] * 60)   # no <head>: the title line stays
