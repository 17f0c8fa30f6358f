"""Routing traps, theme guess, outlet selection, audit rendering, repair status."""

import datetime as dt

from pyspark.sql import functions as F

from pressroom.functions.themes import guess_theme, taxonomy_from_df, theme_scores_join
from pressroom.operators.audit import py_repr, render, repair_status
from pressroom.operators.route import route
from pressroom.sources.outlets import OUTLET_ROWS, list_status, outlets_df, select_outlets

PAIRS = [(k, d) for k, _n, d, *_ in OUTLET_ROWS]


def test_route_first_and_longest(spark):
    urls = ["https://piaui.folha.uol.com.br/x", "https://www1.folha.uol.com.br/a", "https://www.conjur.com.br/b",
            "https://evilconjur.com.br.example/c", "https://unknown.example/d"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(route("url", PAIRS, "first"), route("url", PAIRS, "longest")).collect()]
    assert got == [("folha", "piaui"), ("folha", "folha"), ("conjur", "conjur"), ("conjur", None), (None, None)]
    hinted = df.select(route("url", PAIRS, "first", hint=F.lit(" Globo "))).first()[0]
    assert hinted == "globo"
    assert df.select(route("url", PAIRS, "first", hint=F.lit("nope"))).first()[0] is None


def test_outlet_selection(spark):
    odf = outlets_df(spark)
    assert [r.name for r in list_status(odf).collect()][:2] == ["Conjur", "Migalhas"]
    sel = select_outlets(odf, " Folha,conjur ,, nothere")
    assert [(r.key, r.sel_ord) for r in sel.orderBy("sel_ord").collect()] == [("folha", 1), ("conjur", 2)]
    assert select_outlets(odf).count() == 6


def test_guess_theme(spark):
    texts = ["Operação contra venda de sentença", "filho e filha do juiz na operação", "nada aqui", "clã",
             "escritório"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(guess_theme("t")).collect()]
    assert got == ["venda_sentenca", "filhotismo", "", "parentesco_geral", "filhotismo"]
    tie = spark.createDataFrame([("venda filho",)], "t string")
    assert tie.select(guess_theme("t")).first()[0] == "venda_sentenca"   # tie -> earlier theme


def test_theme_table_forms(spark):
    th = spark.createDataFrame([("b", 2, "beta"), ("a", 1, "alpha"), ("a", 1, "al")],
                               "theme string, theme_ord int, keyword string")
    tax = taxonomy_from_df(th)
    assert list(tax) == ["a", "b"] and tax["a"] == ["al", "alpha"]
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "none")], "k int, t string")
    got = sorted(tuple(r) for r in theme_scores_join(docs, th, "k", "t").collect())
    assert got == [(1, "a", 1, 2), (1, "b", 2, 1)]


def test_py_repr(spark):
    vals = ["plain", "it's", "both ' and \"", "tab\tnew\nline", "back\\slash"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(py_repr("v")).collect()] == [repr(v) for v in vals]


def test_render(spark):
    runs = spark.createDataFrame([("r1", dt.datetime(2024, 3, 5, 14, 7, 59), "venda d'água", "proj"),
                                  ("r2", dt.datetime(2024, 3, 6, 9, 0), "x", "")],
                                 "run_id string, ts timestamp, query string, project_context string")
    res = spark.createDataFrame([("r1", "B", 2, 1, 5, 3, 1, ""), ("r1", "A", 1, 1, 0, 0, 0, "search failed: boom")],
                                "run_id string, outlet string, sel_ord int, pages long, hits long, new long, "
                                "added long, note string")
    got = {r.run_id: r.block for r in render(runs, res).collect()}
    assert got["r1"] == ('## 2024-03-05 14:07 — query: "venda d\'água"\n- _context: proj_\n'
                         "- **A**: 0 hits, 0 new, 0 added (pages: 1) — search failed: boom\n"
                         "- **B**: 5 hits, 3 new, 1 added (pages: 1)\n- **total added: 1**\n\n")
    assert got["r2"] == "## 2024-03-06 09:00 — query: 'x'\n- **total added: 0**\n\n"


def test_repair_status_order(spark):
    rows = [("yes", True, "u", "t"), ("no", True, "u", "t"), ("no", False, "", "t"), ("no", False, "u", "t"),
            ("no", False, "u", None), ("no", False, "u", "")]
    df = spark.createDataFrame(rows, "p string, h boolean, u string, t string")
    assert [r[0] for r in df.select(repair_status("p", "h", "u", "t")).collect()] == \
        ["skipped", "skipped", "failed", "fetched", "failed", "failed"]
    assert [r[0] for r in df.select(repair_status("p", "h", "u", "t", overwrite=True)).collect()][:2] == \
        ["skipped", "fetched"]


def test_route_table_equals_constant_routing(spark):
    from pressroom.operators.route import route, route_table

    rows = [("folha", "folha.uol.com.br"), ("piaui", "piaui.folha.uol.com.br"), ("uol", "uol.com.br"), ("com", "com"), ("x", "x.example"), ("ol", "ol.com")]
    reg = spark.createDataFrame([(k, i, d) for i, (k, d) in enumerate(rows)] + [("later", 99, "uol.com.br"), ("blank", 0, ""), ("none", 0, None)],
                                "key string, ord int, domain string")
    urls = ["https://piaui.folha.uol.com.br/a", "http://UOL.com.br", "https://notuol.com.br/x", "//x.example/y", "https://a.x.example:80/", "nope", "", None,
            "https://other.org/", "https://piaui.folha.uol.com.br/b"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    for mode in ("first", "longest"):
        want = {r.i: r.k for r in df.select("i", route("url", rows, mode).alias("k")).collect()}
        assert {r.i: r.k for r in route_table(df, reg, mode=mode, col="k").collect()} == want, mode
        assert {r.k for r in route_table(df, reg.limit(0), mode=mode, col="k").collect()} == {None}
