"""Selector rules: compiled chains against a direct test of ancestors, rule tables in the lanes, the link table."""

import random

import pytest

from pressroom.operators.domlanes import RULES, dom_dispatch, links, result_items
from pressroom.operators.htmlblocks import FIELDS, parse_page
from pressroom.operators.selectors import RuleSet, _chains, _compound, rules_from_df


def els(html, rules, item=0):
    return [dict(zip(FIELDS, e)) for e in parse_page(html, rules, item)[1]]


def test_chains_and_compounds():
    assert _chains("div.a > p b, [href*='x, y > z']") == [[("", "div.a"), (">", "p"), (" ", "b")], [("", "[href*='x, y > z']")]]
    assert _compound("li.c-x.d[href*='a.b'][property]") == ("li", ("c-x", "d"), (("href", "*=", "a.b"), ("property", "", "")))
    for bad in ("", "a,,b", "p:first", "a[style]", "a[href='x'", "p#id"):
        with pytest.raises(ValueError):
            RuleSet([("o", "r", 0, bad)])
    with pytest.raises(ValueError):
        RuleSet([("o", "r", i, "p") for i in range(64)])


def brute(elements, i, chain):
    """Whether element i meets a chain, by trying all ancestors."""
    above = [j for j in range(i) if elements[j]["ord"] < elements[i]["ord"] < elements[j]["end"]]
    tag, classes, attrs = _compound(chain[-1][1])
    e = elements[i]
    if not ((not tag or e["tag"] == tag) and all(c in e["cls"] for c in classes)
            and all(e[a] is not None and (not op or (e[a] == v if op == "=" else v in e[a])) for a, op, v in attrs)):
        return False
    if len(chain) == 1:
        return True
    parents = above[-1:] if chain[-1][0] == ">" else above
    return any(brute(elements, j, chain[:-1]) for j in parents)


@pytest.mark.parametrize("seed", range(5))
def test_rules_against_ancestors(seed):
    rng = random.Random(seed)
    names = ["div", "p", "b", "a"]

    def page(depth):
        if depth == 0:
            return "x"
        t = rng.choice(names)
        cls = rng.choice(["", " class='k'", " class='k m'", " href='u1'"])
        return f"<{t}{cls}>" + "".join(page(depth - 1) for _ in range(rng.randint(0, 3))) + (f"</{t}>" if rng.random() < 0.9 else "")

    def selector():
        part = lambda: rng.choice(["div", "p", "b", "a", ".k", "p.m", "[href]", "a[href*='u']", "*"])
        return ", ".join("".join(part() + rng.choice([" ", " > ", ">"]) for _ in range(rng.randint(0, 2))) + part() for _ in range(rng.randint(1, 2)))

    rows = [("o", "r", i, selector()) for i in range(12)]
    rules = RuleSet(rows)
    html = "".join(page(5) for _ in range(4))
    got = els(html, rules)
    assert got
    for i, e in enumerate(got):
        for _, _, k, s in rows:
            want = any(brute(got, i, c) for c in _chains(s))
            assert bool(e["rules"] & rules.bit("o", "r", k)) == want, (s, e)
        around = [f for f in got[:i] if f["ord"] < e["ord"] < f["end"]]
        assert e["under"] == e["rules"] | (around[-1]["under"] if around else 0)


def test_items_are_numbered_in_one_pass():
    rules = RuleSet([("f", "item", 0, "li.i")])
    got = els("<a>0</a><li class=i><a>1</a><ul><li class='i x'><b><a>2</a></b></li></ul><a>1</a></li><a>0</a><li class=i><a>3", rules, rules.bit("f", "item"))
    assert [e["item"] for e in got if e["tag"] == "a"] == [0, 1, 2, 1, 0, 3]
    deep = els("<li class=i>" * 2000 + "<a>x", rules, rules.bit("f", "item"))
    assert deep[-1]["item"] == 2000


def test_link_table(spark):
    html = ("<a href=\"/q?a=1&amp;b=2\"> One <b>bold</b> </a><a href='/single'>Two</a><a href=/bare>Three</a><a name=x>no</a>"
            "<A HREF=\"/up\">Four<script>var a='<a href=/no>';</script></A><li class='c-headline'><a href='/in'>Five</a></li>")
    df = spark.createDataFrame([(7, html), (8, None), (9, "")], "page_id long, html string")
    got = [(r.page_id, r.a_pos, r.href, r.title, r["item"]) for r in links(df).orderBy("a_pos").collect()]
    assert got == [(7, 1, "/q?a=1&b=2", "Onebold", 0), (7, 2, "/single", "Two", 0), (7, 3, "/bare", "Three", 0), (7, 4, "/up", "Four", 0),
                   (7, 5, "/in", "Five", 1)]


def test_lanes_with_rules_from_a_table(spark):
    """A nested selector, and an outlet rule changed in the table alone."""
    rows = [r for r in RULES if r[:2] != ("folha", "body")] + [("folha", "body", 0, "main > div.text section")]
    table = spark.createDataFrame(rows, "outlet string, role string, ord int, selector string")
    html = ("<html><body><h1>Head</h1><main><div class='text'><p>Before the section here</p><section><p>Inside the section here</p>"
            "<div class='c-ad'><p>Dropped advert text</p></div></section></div></main><div class='text'><section><p>Elsewhere entirely</p></section></div></body></html>")
    df = spark.createDataFrame([("u", html, "folha", 5)], "url string, html string, lane string, min_chars int")
    r = dom_dispatch(df, rules=rules_from_df(table)).collect()[0]
    assert r.text == "Head\n\n\n\nInside the section here" and r.ok
    assert "Before the section here" in dom_dispatch(df).collect()[0].text       # the default rules find no body: whole page
    items = result_items(spark.createDataFrame([(1, "<ol><li class='hit'><a href='https://n.example/1?x'>T</a></li></ol>")], "page int, html string"),
                         rules=RuleSet([("n", "item", 0, "ol > li.hit"), ("n", "item_link", 0, "a[href*='n.example']"), ("n", "item_date", 0, "time")]),
                         outlet="n", domain="n.example")
    assert [(r.item_pos, r.url, r.title) for r in items.collect()] == [(1, "https://n.example/1", "T")]
