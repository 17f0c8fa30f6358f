"""The keyword automaton against substring tests; theme tables; redirect chains."""

import random
import time

from pressroom.functions.themes import guess_theme_join, theme_scores_join
from pressroom.operators.keywords import Automaton, keyword_blocks, keyword_hits


def test_automaton_against_substrings():
    rng = random.Random(3)
    for _ in range(400):
        words = list({"".join(rng.choices("abé", k=rng.randint(0, 4))) for _ in range(rng.randint(0, 12))})
        text = "".join(rng.choices("abéx", k=rng.randint(0, 30)))
        assert Automaton(enumerate(words)).found(text) == {i for i, w in enumerate(words) if w in text}, (words, text)


def test_automaton_is_linear_in_the_text():
    machine = Automaton(enumerate(["a" * n for n in range(1, 60)] + ["ação", "são"]))
    text = "a" * 200 + "ação " * 16_000

    def seconds(t):
        best = 1e9
        for _ in range(3):
            at = time.process_time()
            machine.found(t)
            best = min(best, time.process_time() - at)
        return best

    assert seconds(text * 4) < 8 * seconds(text)       # four times the text; quadratic would be sixteen


def test_keyword_blocks_and_hits(spark):
    words = [(f"w{i}",) for i in range(300)] + [("long" * 50,), ("",), (None,), ("w1",)]
    kw = spark.createDataFrame(words, "keyword string")
    dealt, blocks = keyword_blocks(kw, 400)
    sizes = {r.block: (r.n, r.k) for r in dealt.selectExpr("block", "length(keyword) + 1 as n").groupBy("block").agg({"n": "sum", "*": "count"}).toDF("block", "n", "k").collect()}
    assert blocks > 3 and all(n <= 400 or k == 1 for n, k in sizes.values())
    docs = spark.createDataFrame([(1, "W12 and w299."), (2, None), (3, ""), (None, "w7")], "id long, body string")
    want = {(1, "w12"), (1, "w1"), (1, "w299"), (1, "w29"), (1, "w2"), (1, ""), (3, ""), (None, "w7"), (None, "")}
    for chars in (400, 1 << 20):
        got = keyword_hits(docs, kw, "id", "body", chars).collect()
        assert {(r.id, r.keyword) for r in got} == want and len(got) == len(want)
    assert keyword_hits(docs, kw.limit(0), "id", "body").count() == 0


def test_theme_table(spark):
    themes = spark.createDataFrame([("b", 2, "sol"), ("b", 2, "mar"), ("a", 1, "sol"), ("a", 1, "céu"), ("a", 1, "sol"), ("c", 3, None)],
                                   "theme string, theme_ord int, keyword string")
    docs = spark.createDataFrame([(1, "Sol, sol e CÉU"), (2, "mar sol"), (3, "nada"), (4, None), (5, "consolo")], "id long, t string")
    got = {(r.id, r.theme): r.n for r in theme_scores_join(docs, themes, "id", "t").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1, (2, "b"): 2, (5, "a"): 1, (5, "b"): 1}
    assert {r.id: r.theme for r in guess_theme_join(docs, themes, "id", "t").collect()} == {1: "a", 2: "b", 3: "", 4: "", 5: "a"}


def test_redirect_chains(spark):
    from pressroom.sources.feeds import redirect_ends, resolve_redirects

    w = "https://news.google.com/"
    chain = [(f"{w}c{i}", f"{w}c{i + 1}") for i in range(20)] + [(f"{w}c20", "https://end/")]
    ring = [(f"{w}r0", f"{w}r1"), (f"{w}r1", f"{w}r2"), (f"{w}r2", f"{w}r0"), (f"{w}in", f"{w}r1"), (f"{w}self", f"{w}self")]
    rows = chain + ring + [(f"{w}two", "https://b/"), (f"{w}two", "https://a/"), (None, "x"), (f"{w}n", None)]
    red = spark.createDataFrame(rows, "from_url string, to_url string")
    ends = {r.from_url: r.to_url for r in redirect_ends(red).collect()}
    assert ends == {**{f"{w}c{i}": "https://end/" for i in range(21)}, f"{w}two": "https://a/"}
    stubs = spark.createDataFrame([(u,) for u in (f"{w}c0", f"{w}r0", f"{w}in", f"{w}two", f"{w}self", f"{w}unknown", "https://plain/")], "url string")
    got = [r.url for r in resolve_redirects(stubs, red).collect()]
    assert sorted(got) == sorted(["https://end/", f"{w}r0", f"{w}in", "https://a/", f"{w}self", f"{w}unknown", "https://plain/"])
    assert redirect_ends(red.limit(0)).count() == 0
