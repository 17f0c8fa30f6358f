"""DOM lanes on hand-written pages; expected values worked out by hand."""

from pyspark.sql import functions as F

from pressroom.operators.domlanes import dom_dispatch, result_items
from pressroom.operators.htmlblocks import parse_blocks

FOLHA = """<html><head><script>var a = "<p>not text</p>";</script></head><body>
<header><h1>Site header</h1></header>
<nav><p>Navigation entry long enough</p></nav>
<article>
<h1>Main &amp; title</h1>
<h2 class="c-news__subtitle">The subtitle</h2>
<p class="c-news__author">Ana Souza</p>
<time>12.mar.2024</time>
<div class="c-news__body">
<p>First paragraph of the body text.</p>
<h2>Section heading</h2>
<p>short</p>
<p>Carregando the comments now</p>
<div class="c-ad"><p>Advertisement block text</p></div>
<p>https://fotografia.folha.uol.com.br/galeria/1</p>
<p>Second paragraph, <b>bold</b> part.</p>
</div></article><footer><p>Footer text that is long</p></footer></body></html>"""


def _one(spark, html, lane, min_chars=10):
    df = spark.createDataFrame([("u", html, lane, min_chars)], "url string, html string, lane string, min_chars int")
    return dom_dispatch(df).collect()[0]


def test_blocks_text_and_nesting():
    b = parse_blocks("<div class='a b'><p>x <b>y</b></p><br><p>z</p></div>")
    assert [e["tag"] for e in b] == ["div", "p", "b", "br", "p"]
    assert b[0]["cls"] == ["a", "b"]
    assert b[0]["text"] == "xyz"
    assert b[1]["text"] == "xy" and b[1]["lines"] == "x\ny"
    assert b[2]["anc"] == [0, 1]
    assert b[4]["anc"] == [0]


def test_blocks_skip_script_and_decode_entities():
    b = parse_blocks("<p>a &amp; b</p><script>var x='<p>';</script><style>p{}</style>")
    assert b[0]["text"] == "a & b"
    assert b[1]["text"] == "" and b[2]["text"] == ""


def test_folha_lane(spark):
    r = _one(spark, FOLHA, "folha")
    assert r.title == "Main & title"
    assert r.date == "2024-03"
    # The body selector list takes the first match in document order: <article>
    # encloses div.c-news__body, so the article is the container and its h2
    # subtitle is a (padded) body heading too; the 9-char author line is junk.
    assert r.text == ("Main & title\n\nThe subtitle\n\nAna Souza\n\n12.mar.2024\n\n\n\n"
                      "\nThe subtitle\n\n\n"
                      "First paragraph of the body text.\n\n\nSection heading\n\n\n"
                      "Second paragraph,boldpart.")
    assert r.summary == "The subtitle"
    assert r.ok


def test_folha_fallback_without_container(spark):
    html = "<html><body><h1>T</h1><section><p>Body text here</p></section></body></html>"
    r = _one(spark, html, "folha")
    # no container: the readable text of the whole page follows the '' part
    assert r.text == "T\n\n\n\nT\n\nBody text here"


def test_globo_lane_preference_order(spark):
    html = ("<html><head><meta property=\"og:title\" content=\"OG title\">"
            "<meta property=\"og:description\" content=\"A description that is longer than thirty chars\">"
            "<meta property=\"article:published_time\" content=\"2024-05-06T10:00:00Z\"></head><body>"
            "<article><p>Article paragraph one</p></article>"
            "<div class=\"article__content-container\"><p>Preferred container text</p>"
            "<p>Leia mais sobre o tema</p><aside><p>Aside text long enough</p></aside></div></body></html>")
    r = _one(spark, html, "globo")
    assert r.title == "OG title"
    assert r.date == "2024-05-06"
    assert r.text == ("OG title\n\nA description that is longer than thirty chars\n\n2024-05-06\n\n\n\n"
                      "Preferred container text")
    assert r.summary == "A description that is longer than thirty chars"


def test_piaui_cascade(spark):
    long = "x" * 250
    html = (f"<html><body><h1> Title </h1><div class='post-content'><p>short body</p></div>"
            f"<article><p>{long}</p></article></body></html>")
    r = _one(spark, html, "piaui", 200)
    assert r.title == "Title"
    assert r.text == "Title\n\n" + long
    assert r.summary == long[:300]
    html2 = "<html><body><div class='entry-content'><p>only short</p></div></body></html>"
    r2 = _one(spark, html2, "piaui", 5)
    assert r2.text == "only short" and r2.title == ""


def test_result_items(spark):
    html = ("<ol><li class='c-headline'><a href='https://www1.folha.uol.com.br/a.shtml?x=1'>First</a>"
            "<a href='https://www1.folha.uol.com.br/b.shtml'></a><time>3.abr.2024</time></li>"
            "<li class='c-headline'><a href='https://other.example/'>No domain</a></li>"
            "<li class='c-headline'><a href='https://www1.folha.uol.com.br/c.shtml'>Third</a></li></ol>")
    df = spark.createDataFrame([("q", 1, html)], "search string, page_no int, html string")
    rows = sorted(result_items(df).select("item_pos", "url", "title", "date").collect())
    assert [tuple(r) for r in rows] == [
        (1, "https://www1.folha.uol.com.br/b.shtml", "First", "2024-04"),
        (3, "https://www1.folha.uol.com.br/c.shtml", "Third", ""),
    ]


def test_text_and_orders_of_odd_markup():
    b = parse_blocks("<p>a < b and c</p><p>x<!-- c -->y</p>")
    assert [x["text"] for x in b] == ["a < b and c", "xy"]
    from pressroom.operators.htmlblocks import parse_page

    _, els, failed = parse_page("<p>" * 3000)                 # never closed: one subtree in the other
    assert not failed and len(els) == 3000 and all(e[3] == 3000 for e in els)
    assert all(len(e) == 14 for e in els)                     # no element holds its ancestors


def test_decode_entities(spark):
    from pyspark.sql import functions as F

    from pressroom.functions.text import decode_entities

    rows = [("opera&ccedil;&atilde;o &#8217;x&eacute; &#x1F600; &amp;lt; &nope; & &#0; AT&T; &nbsp;|", "operação ’xé \U0001F600 &lt; &nope; & &#0; AT&T;  |"),
            ("plain", "plain"), (None, None), ("&", "&"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("c", decode_entities(F.col("a")))
    assert [(r.c, r.b) for r in df.collect() if r.c != r.b] == []


def test_pages_are_parsed_in_pieces():
    """One batch, however many pages it holds, is parsed and handed on some bytes at a time."""
    import pyarrow as pa

    from pressroom.operators.htmlblocks import PIECE, pages_to_arrow, parse_pieces

    html = "<ol>" + "<li class='c-headline'><a href='https://folha.uol.com.br/x'>título</a></li>" * 1500 + "</ol>"
    pages = [None, "", html, "<p>" + "x" * (2 * PIECE) + "</p>", *[html] * 40, None]
    batch = pa.array(["skipped", *pages]).slice(1)
    size = [len(p.encode()) if p else 0 for p in pages]
    got, at = [], 0
    for part in parse_pieces(iter([batch, batch.slice(0, 0)])):
        assert len(part) == 1 or sum(size[at: at + len(part)]) <= PIECE
        got += part.to_pylist()
        at += len(part)
    assert got == pages_to_arrow(pages).to_pylist()


def test_pieces_of_a_batch_keep_their_rows(spark):
    """All pages of a task in one Arrow batch, which is several pieces: each row gets its own page's elements."""
    from pressroom.operators.htmlblocks import html_page

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        d = spark.range(0, 3000, 1, 1).selectExpr("id", "concat('<p>', repeat(cast(id as string), 300), '</p>', repeat('<b>y</b>', 20)) as html")
        pg = d.select("id", html_page("html").alias("pg")).selectExpr("id", "size(pg.els) as n", "pg.nodes[0] = repeat(cast(id as string), 300) as same")
        assert pg.where("n = 21 and same").count() == 3000
    finally:
        spark.conf.set(name, before)


def test_collect_moves_the_text_of_one_lane(spark, monkeypatch):
    """Three DOM lanes ask for the same pages: one text of each page is stored, that of the first outlet whose lane is ok."""
    from pressroom.plans import collect as C
    from pressroom.sources.outlets import outlets_df, select_outlets

    para = "<p>Texto do corpo com bastante conteúdo. " + "z" * 400 + "</p>"
    html = {"https://x.example/all": f"<body><h1>T</h1><div class='c-news__body article__content-container post-content'>{para}</div></body>",
            "https://x.example/short": "<body><div class='c-news__body'><p>Curto demais aqui.</p></div><div class='article__content-container'>" + para + "</div></body>",
            "https://x.example/none": "<body></body>"}
    pages = spark.createDataFrame(list(html.items()), "url string, html string")
    rows = [(k, 1, i, u, "", "") for k in ("folha", "globo", "piaui") for i, u in enumerate([*html, "https://x.example/missing"])]
    stubs = spark.createDataFrame(rows, "outlet_key string, page_no int, stub_ord int, url string, title string, date string")
    store = spark.createDataFrame([], "row_num long, url string")
    kept = []
    real = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: kept.append(real(df)) or kept[-1])
    for keys in ("folha,globo,piaui", "piaui,globo,folha"):
        kept.clear()
        sel = select_outlets(outlets_df(spark), keys)
        res = C.collect(stubs, pages, sel, store, with_dom=True)
        ex = {(r.url, r.lane): r for r in kept[0].collect()}
        assert len(ex) == 12
        plain = C.extract_pages(C.attach_outlets(stubs, sel).select("url", "lane", "min_chars").distinct(), pages, True)
        want = {(r.url, r.lane): r for r in plain.collect()}
        for k, r in want.items():
            assert (ex[k].ok, ex[k].title, ex[k].date) == (r.ok, r.title, r.date)
        turn = {r.lane: r.sel_ord for r in sel.select("lane", "sel_ord").collect()}
        first = {}
        for (u, lane), r in sorted(want.items(), key=lambda x: turn[x[0][1]]):
            if r.ok:
                first.setdefault(u, lane)
        assert first
        for (u, lane), r in ex.items():
            assert (r.text, r.summary) == ((want[u, lane].text, want[u, lane].summary) if first.get(u) == lane else (None, None))
        num = {r.row_num: r.url for r in res.articles.collect()}
        assert {num[r.row_num]: r.text for r in res.texts.collect()} == {u: want[u, lane].text for u, lane in first.items()}
