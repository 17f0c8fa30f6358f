"""collect against a direct simulation of the sequential outlet loop."""

import random

from pyspark.sql import functions as F

from pressroom.plans.collect import collect, dry_run
from pressroom.sources.outlets import outlets_df, select_outlets

OUTLETS = [  # key, name, domain, status, search, min_chars, lane
    ("a", "A", "a.example", "working", "native", 100, "generic"),
    ("b", "B", "b.example", "working", "native", 300, "generic"),
    ("c", "C", "c.example", "working", "native", 50, "generic"),
    ("d", "D", "d.example", "disabled", "native", 50, "generic"),
]


def simulate(order, stubs, lengths, mins, store):
    existing = set(store)
    rows, res = [], []
    base = len(store) + 1
    for key in order:
        hits = [s for s in stubs if s[0] == key]
        new = [s for s in hits if s[3] not in existing]
        added = 0
        for s in new:
            n = lengths.get(s[3])
            if n is None or n < mins[key] or s[3] in existing:
                continue
            rows.append((base + len(rows), key, s[3]))
            existing.add(s[3])
            added += 1
        res.append((key, len(hits), len(new), added))
    return rows, res


def _case(spark, seed):
    rnd = random.Random(seed)
    urls = [f"https://p.example/{i}" for i in range(12)]
    lengths = {u: rnd.choice([30, 80, 150, 400]) for u in urls[:10]}   # two URLs have no page
    stubs = []
    for key in ("a", "b", "c", "d"):
        for page in (1, 2):
            for j in range(rnd.randrange(0, 6)):
                stubs.append((key, page, j, rnd.choice(urls)))
    store = rnd.sample(urls, 3)
    pages = spark.createDataFrame([(u, "<p>" + "x" * (n - 3) + "</p>" if n > 3 else "x") for u, n in lengths.items()],
                                  "url string, html string")
    # generic lane text of '<p>xxx</p>' is the x run: length n - 3 + ... keep exact lengths below
    text_len = {u: len("x" * (n - 3)) for u, n in lengths.items()}
    sdf = spark.createDataFrame([(k, p, j, u, "", "") for k, p, j, u in stubs],
                                "outlet_key string, page_no int, stub_ord int, url string, title string, date string")
    st = spark.createDataFrame([(i + 1, u) for i, u in enumerate(store)], "row_num long, url string")
    return stubs, text_len, store, pages, sdf, st


def test_collect_matches_sequential_loop(spark):
    odf = outlets_df(spark, OUTLETS)
    for seed in range(6):
        stubs, text_len, store, pages, sdf, st = _case(spark, seed)
        sel = select_outlets(odf, "c, A,b,d,zz")
        res = collect(sdf, pages, sel, st, with_dom=False)
        mins = {k: m for k, _, _, _, _, m, _ in OUTLETS}
        order_stubs = sorted(stubs, key=lambda s: (s[1], s[2]))
        rows, counts = simulate(["c", "a", "b"], order_stubs, text_len, mins, store)
        got_rows = [(r.row_num, r.outlet, r.url) for r in res.articles.orderBy("row_num").collect()]
        names = {"a": "A", "b": "B", "c": "C"}
        assert got_rows == [(n, names[k], u) for n, k, u in rows], seed
        got = {r.outlet: (r.hits, r.new, r.added) for r in res.outlet_results.collect()}
        assert got == {names[k]: (h, n, a) for k, h, n, a in counts}, seed
        for h, n, a in got.values():
            assert h >= n >= a


def test_second_run_adds_nothing(spark):
    odf = outlets_df(spark, OUTLETS)
    stubs, text_len, store, pages, sdf, st = _case(spark, 3)
    sel = select_outlets(odf, "a,b,c")
    first = collect(sdf, pages, sel, st, with_dom=False)
    store2 = st.unionByName(first.articles.select("row_num", "url"))
    second = collect(sdf, pages, sel, store2, with_dom=False)
    assert second.articles.count() == 0
    # stubs whose page never extracts stay "new" on every run, as in the sequential loop
    known = {r.url for r in store2.collect()}
    assert sum(r.new for r in second.outlet_results.collect()) == sum(1 for s in stubs if s[0] != "d"
                                                                     and s[3] not in known)


def test_dry_run(spark):
    st = spark.createDataFrame([(1, "https://k")], "row_num long, url string")
    stubs = spark.createDataFrame([("a", "https://k", "", "t"), ("a", "https://n", "2024-01-01", "x" * 100)],
                                  "outlet_key string, url string, date string, title string")
    got = [tuple(r) for r in dry_run(stubs, st).collect()]
    assert got == [("a", "https://n", "2024-01-01", "x" * 80)]
    stubs2 = stubs.withColumn("date", F.lit(""))
    assert dry_run(stubs2, st).collect()[0].date == "?"


def test_collect_with_dom_lanes(spark):
    """A URL found by the folha and globo outlets: folha's DOM lane fails its
    300-char gate, so globo's extraction is the one stored; piaui reads the
    same page with its own rules."""
    long_p = "<p>" + "word " * 80 + "</p>"
    html_a = f"<html><body><article><h1>A title</h1>{long_p}</article></body></html>"
    html_b = "<html><body><div class='post-content'><p>short text only</p></div></body></html>"
    pages = spark.createDataFrame([("https://x/a", html_a), ("https://x/b", html_b)], "url string, html string")
    rows = [("folha", 1, 1, "https://x/b"), ("globo", 1, 1, "https://x/b"), ("globo", 1, 2, "https://x/a"),
            ("piaui", 1, 1, "https://x/a")]
    stubs = spark.createDataFrame([(k, p, j, u, "stub", "") for k, p, j, u in rows],
                                  "outlet_key string, page_no int, stub_ord int, url string, title string, date string")
    store = spark.createDataFrame([], "row_num long, url string")
    sel = select_outlets(outlets_df(spark), "folha,globo,piaui")
    res = collect(stubs, pages, sel, store, with_dom=True)
    got = [(r.row_num, r.outlet, r.url, r.title) for r in res.articles.orderBy("row_num").collect()]
    # b: too short for every lane; a: globo (second outlet) stores it before piaui
    assert got == [(1, "O Globo", "https://x/a", "A title")]
    counts = {r.outlet: (r.hits, r.new, r.added) for r in res.outlet_results.collect()}
    assert counts == {"Folha de S.Paulo": (1, 1, 0), "O Globo": (2, 2, 1), "piaui": (1, 0, 0)}


def test_collect_independent_of_partitioning(spark):
    odf = outlets_df(spark, OUTLETS)
    stubs, text_len, store, pages, sdf, st = _case(spark, 5)
    sel = select_outlets(odf, "b,a,c")
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res = collect(sdf.repartition(int(n)), pages, sel, st, with_dom=False)
            results.append(sorted(tuple(r) for r in res.articles.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] and results[0]


def test_two_captures_of_one_url_and_an_outlet_named_twice(spark):
    from pressroom.plans.collect import collect
    from pressroom.sources.outlets import outlets_df, select_outlets

    url = "https://www.conjur.com.br/p/1"
    page = "<p>" + "x" * 400 + "</p>"
    stubs = spark.createDataFrame([("conjur", 1, 1, url, "t", "")], "outlet_key string, page_no int, stub_ord long, url string, title string, date string")
    pages = spark.createDataFrame([(2, url, page + "later"), (1, url, page), (1, url, page)], "page_id long, url string, html string")
    store = spark.createDataFrame([], "row_num long, url string")
    res = collect(stubs, pages, select_outlets(outlets_df(spark), "conjur,conjur"), store, with_dom=False)
    assert [(r.row_num, r.url) for r in res.articles.collect()] == [(1, url)]
    assert [(r.sel_ord, r.hits, r.new, r.added) for r in res.outlet_results.orderBy("sel_ord").collect()] == [(1, 1, 1, 1), (2, 1, 0, 0)]
