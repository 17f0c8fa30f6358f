"""Regex extraction lanes: gates at their edges, paragraph slice edges, fallbacks."""

from pressroom.operators.lanes import apply_lane, regex_dispatch

P = "p" * 60


def _lane(spark, html, lane, url="https://x.example/a", min_chars=None):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    return apply_lane(df, lane, min_chars=min_chars).collect()[0]


def test_meta_gate_edge(spark):
    body = "a" * 296                                   # "<p>" + body + "</p>" -> text of 296 chars
    r299 = _lane(spark, "<p>" + body + "bcd</p>", "meta")   # 299 chars
    r300 = _lane(spark, "<p>" + body + "bcde</p>", "meta")  # 300 chars
    assert len(r299.text) == 299 and not r299.ok
    assert len(r300.text) == 300 and r300.ok


def test_meta_title_and_date_fallbacks(spark):
    r = _lane(spark, "<title>Page - Site</title><p>x</p>", "meta")
    assert r.title == "Page" and r.date == ""
    r = _lane(spark, '<meta property="og:title" content="OG"><title>T</title><time datetime="2024-02-03T10:00">',
              "meta")
    assert r.title == "OG" and r.date == "2024-02-03"
    r = _lane(spark, '<time datetime="2024-02-03T10:00">', "paragraph")
    assert r.date == ""                                 # the paragraph lane has no <time> fallback


def test_paragraph_slice_edges(spark):
    five = "".join(f"<p>{P}{i}</p>" for i in range(5))
    six = "".join(f"<p>{P}{i}</p>" for i in range(6))
    r5 = _lane(spark, five, "paragraph")
    r6 = _lane(spark, six, "paragraph")
    assert r5.text == "\n\n".join(f"{P}{i}" for i in range(5))
    assert r6.text == "\n\n".join(f"{P}{i}" for i in range(1, 4))    # first and last two dropped
    assert r6.summary == f"{P}1 {P}2"
    assert r5.ok                                        # 5 x 61 chars + separators >= 200
    assert not r6.ok                                    # the gate applies after the slice: 187 chars
    two = "".join(f"<p>{P}{i}{'q' * 200}</p>" for i in range(2))
    assert not _lane(spark, two, "paragraph").ok        # fewer than three paragraphs


def test_generic_lane_outlet_and_gate(spark):
    df = spark.createDataFrame([("https://Host.Example/a", "<p>" + "z" * 199 + "</p>"),
                                ("https://Host.Example/b", "<p>" + "z" * 200 + "</p>")], "url string, html string")
    rows = sorted(apply_lane(df, "generic").collect(), key=lambda r: r.url)
    assert [r.ok for r in rows] == [False, True]
    assert rows[1].title == "" and rows[1].summary == "z" * 200


def test_dispatch_unknown_lane_fails(spark):
    df = spark.createDataFrame([("u", "<p>x</p>", "nope", 1)], "url string, html string, lane string, min_chars int")
    assert regex_dispatch(df).collect()[0].ok is False
