"""Sharding, packing, vectors, language, toxicity and page text on small tables."""

import random
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def test_interleave_counts_and_mixture(spark):
    from pyspark.sql import functions as F

    from pressroom.llm.sharding import interleave

    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 7}", i) for i in range(1000)] + [(5, "s5", 5), (None, "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _key long").withColumn("shard", F.lit(-1))
    got = interleave(df, 40).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(40))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        assert abs(sum(r.source == "hot" for r in v) - len(v) * 334 / 1002) <= 2
    assert interleave(df.limit(0), 40).count() == 0
    assert sorted((r.shard, r.slot, str(r.doc_id)) for r in got) == sorted((r.shard, r.slot, str(r.doc_id)) for r in interleave(df.repartition(5), 40).collect())


def test_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pressroom.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "a", "Hello  two spaces. <|endoftext|> And more!", " lead", "trail ", "tab\t x\n\n y", "é" * 500, "word " * 9000, "x" * 20000,
             "No end of sentence here " * 700, "One. Two! Three? " * 900, "  　", "same text.", "same text."]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as offset", "'z' as part").repartition(3)
    got = pack(df, path, window=256).collect()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by[i], key=lambda r: r.start)
        assert [x for r in parts for x in r["ids"]] == ids
        at = 0
        for r in parts:
            assert (r.start, r.length, r.doc_tokens) == (at, len(r["ids"]), len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r.length
    assert sorted(seq) == list(range(len(seq)))
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert pack(df.limit(0), path).count() == 0


def test_pack_special_tokens_as_the_file_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pressroom.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one<|endoftext|>two  three", "plain text of some words", "<|endoftext|", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(path)
    want = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    got = {r.doc_id: r["ids"] for r in packing.pack(df, path, special_tokens=True).collect()}
    assert got == want and 50256 in got[0]


def test_encoder_reads_its_file_once(monkeypatch):
    """One tokenizer serves texts with and without marks, whichever comes first."""
    import public_tokenizers
    import tokenizers

    from pressroom.llm.tokens import Encoder

    path, read = public_tokenizers.path("byte_bpe_50k.json"), []

    class Counted:
        @staticmethod
        def from_file(p):
            read.append(p)
            return real.from_file(p)

    real = tokenizers.Tokenizer
    whole = real.from_file(path)
    mark = next(t.content for t in whole.get_added_tokens_decoder().values())
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    enc, plain = Encoder(path, True), Encoder(path)
    assert len(read) == 2                                # one for each encoder
    texts = [f"a text {mark} with a mark", "and one without", mark, f"{mark}{mark} at the end {mark}"]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert enc.tok.encode_special_tokens             # as ordinary text again
    whole.encode_special_tokens = True
    assert [x.tolist() for x in plain.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_op9_query_special_tokens(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from pressroom.llm import packing

    texts = ["a <|endoftext|> b", "plain text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in packing.q_op9_pack(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.stage_pack(spark, docs, str(tmp_path)).collect()} == want


def test_best_cuts_is_optimal():
    from pressroom.llm.packing import best_cuts

    g = random.Random(1)
    for _ in range(60):
        pos = np.cumsum([0] + [g.randint(1, 9) for _ in range(g.randint(1, 40))])
        pen = np.array([0.0] + [g.choice([0, 3, 8.0]) for _ in pos[1:]])
        n = len(pos)
        best = [0.0] + [float("inf")] * (n - 1)
        for j in range(1, n):
            best[j] = min(best[i] + 16 - (pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= 16) + pen[j]
        cuts = best_cuts(pos, pen, 16, True)
        assert cuts[0] == 0 and cuts[-1] == n - 1
        cost = sum(16 - (pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:]))
        assert all(pos[b] - pos[a] <= 16 for a, b in zip(cuts, cuts[1:])) and cost == best[-1]


def vectors(seed=0, dim=64):
    g = np.random.default_rng(seed)
    x = g.normal(size=(300, dim))
    near = []
    for v in x[:80]:
        r = g.normal(size=dim)
        r -= (r @ v) / (v @ v) * v
        c = g.uniform(0.88, 0.99)
        near.append(c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * r / np.linalg.norm(r))
    return np.concatenate([x, near, np.tile(x[5], (40, 1)), x[6:8] * 2.5, -x[9:10]])


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors_brute_force(spark, block, monkeypatch):
    from pressroom.llm import neardup_vec as K

    monkeypatch.setattr(K, "BLOCK", block)
    x = vectors()
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] + [1.0] * 63), (1004, [None] + [1.0] * 63), (1005, [1.0, 0.0]),
           (1006, [2.0, 0.0]), (1007, [float("inf")] * 64), (None, rows[5][1])]
    df = spark.createDataFrame(rows + [(i, v, 1) for i, v in odd] + [rows[0]], "vec_id long, embedding array<double>, label int").selectExpr("*", "7 as id", "8 as rep", "9 as n")
    got = K.near_vectors(df).collect()
    assert len(got) == len(rows) + len(odd) + 1
    all_ = np.concatenate([x, x[:1]])
    u = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    ids = [*range(len(x)), 0]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    comp = list(range(len(u)))
    for _ in range(len(u)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(u))]
        if new == comp:
            break
        comp = new
    want = sorted((ids[i], int(link[i].sum()), ids[comp[i]], ids[comp[i]] == ids[i]) for i in range(len(u)))
    main = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id < 1000)
    assert main == want                                          # every pair is found here
    rest = {r.vec_id: r for r in got if r.vec_id is None or r.vec_id >= 1000}
    for i in (1000, 1001, 1002, 1003, 1004, 1007, None):
        assert (rest[i].n_links, rest[i].component_id) == (0, i)
    assert rest[1005].n_links == rest[1006].n_links == 1 and rest[1006].component_id == 1005
    assert K.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_recall_at_the_threshold():
    from pressroom.llm import neardup_vec as K

    g = np.random.default_rng(4)
    x = g.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = g.normal(size=x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * r
    met = K._met(K.buckets(K.axes(x), 64), K.buckets(K.axes(y), 64))
    assert (met > 0).any(axis=1).mean() >= 0.995


def test_language_held_out(spark):
    from pressroom.llm import langid

    rows = {r.doc_id: r for r in langid.q_op10_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(rows[d.doc_id].held_out == (d in held) for d in docs)
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)


def test_language_edges(spark):
    from pyspark.sql import functions as F

    from pressroom.llm import langid

    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%% \n"), (None, "the of and"), (5, "é"), (6, "der die das " * 50000), (6, "x")], "doc_id long, text string")
    train = spark.createDataFrame([(t, l) for l, t in (("en", "the of and to in that "), ("de", "der die das und nicht ")) for t in [t * k for k in range(3, 30)]] + [(None, "en"), ("x", None)],
                                  "text string, lang string")
    net = langid.fit(train)
    got = langid.predict(df.withColumn("_letters", F.lit("clash")).withColumn("score", F.lit(9)), net).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert {r.lang_pred for r in got if r.doc_id == 6 and len(r.text) > 9} == {"de"} and all(0 <= r.score <= 1 for r in got)
    assert langid.fit(train.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), net).count() == 0


def test_language_learns_from_all_texts_beside_copies(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pressroom.llm import langid

    texts = [f"{a}{b} " * 20 for a in "abcdefgh" for b in "mnopq"]
    hashed = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text", F.lit(3)).alias("h"))
    first = hashed.orderBy("h").first().text              # its copies stand before all other texts
    rows = [(t, "en") for t in texts] + [(first, "en")] * 999 + [("der die das und nicht " * 9, "de")]
    seen = []
    monkeypatch.setattr(langid.ByteCNN, "train", lambda self, x, y, weight: seen.append((x, y)))
    net = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    (x, y), = seen
    x = x[y == net.classes.index("en")]
    assert len({row[:3].tobytes() for row in x}) == len(x) == len(texts)      # a window of each text, none twice


def test_byte_cnn_gradients():
    from pressroom.llm.langid import WINDOW, ByteCNN

    g = np.random.default_rng(0)
    x = g.integers(97, 103, (40, WINDOW)).astype(np.uint8)
    y = np.arange(40) % 2
    x[y == 1, 30:33] = [120, 121, 122]                           # one trigram tells the classes apart
    net = ByteCNN(["a", "b"])
    net.train(x, y, np.ones(40, np.float32), epochs=60, batch=8, rate=0.01)
    assert (net.probabilities(x).argmax(axis=1) == y).mean() >= 0.95


def test_toxicity_held_out(spark):
    from pressroom.llm import toxicity

    rows = {r.doc_id: r for r in toxicity.q_op2_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None and rows[r.doc_id].held_out]
    bad, good = ([r for r in labels if r.toxic == k] for k in (1, 0))
    assert sum(rows[r.doc_id].predicted for r in bad) >= 0.6 * len(bad)
    assert sum(rows[r.doc_id].predicted for r in good) <= 0.1 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_toxicity_edges(spark):
    from pressroom.llm import toxicity

    g = random.Random(1)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(5))
    prose = lambda: [word() for _ in range(80)]
    rows = []
    for i in range(120):
        w = prose()
        if i % 3 == 0:
            for _ in range(5):
                w[g.randrange(80)] = g.choice(["villain", "rotter!", "SCOUNDREL"])
        rows.append((" ".join(w), int(i % 3 == 0)))
    train = spark.createDataFrame(rows + [(None, 1), ("x", None), ("y", 7)], "text string, toxic int")
    model = toxicity.fit(train)
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(prose()) + " villain villain scoundrel " + " ".join(prose())), (3, " ".join(prose())), (None, "word " * 100000)],
                               "doc_id long, text string").selectExpr("*", "0 as predicted", "'x' as label")
    got = [r.predicted for r in toxicity.score(df, model).collect()]
    assert got[:2] == [0, 0] and got[3] == 0 and got[4] == 0 and got[2] == 1
    assert toxicity.fit(train.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_main_text_held_out_pages():
    from pressroom.llm import htmlcrf as K

    chain = K.train()
    right = total = 0
    for seed in range(5000, 5120):
        page, rows = K.labelled_page(seed)
        bs = K.blocks(page)
        got = chain.decode(chain.emissions(K.features(bs)))
        right += sum(a == k for a, (_, k) in zip(got, rows))
        total += len(rows)
    assert right >= 0.95 * total


def test_main_text_of_pages(spark):
    from pressroom.llm import htmlcrf as K

    chain = K.train()
    page = ('<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></ul></nav>'
            '<div class="ad">Buy this now, it is cheap.</div><article><h1>A title here</h1><p>First &amp; second &eacute;t&eacute;,\n  with <b>bold</b>ness and a < b.'
            "<p>Another paragraph of some length, unclosed.</article><div class='comments'><p>I do not agree with this at all.</p></div>"
            '<footer>&copy; site</footer>')
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = [(r.page_id, r.text) for r in K.extract(df, chain).collect()]
    text = "A title here First & second été, with boldness and a < b. Another paragraph of some length, unclosed."
    assert got == [(1, text), (2, ""), (3, ""), (None, ""), (1, text)]
    assert K.extract(df.limit(0), chain).count() == 0


def test_main_text_after_self_closing_svg_and_open_head():
    from pressroom.llm import htmlcrf as K

    chain = K.train()
    article = "<article><h1>A title here</h1><p>First of all, this is a long sentence with some words in it.</p><p>Another paragraph of some length.</p></article>"
    text = "A title here First of all, this is a long sentence with some words in it. Another paragraph of some length."
    head = "<head><meta charset='utf-8'><title>t</title><script>x</script><noscript>Switch on scripts</noscript>"
    for svg in ("<svg/>", "<svg class='i' />", '<svg d="a=b/"/>', "<svg d=a/><path/></svg>", "<svg><text>no</text></svg>"):
        assert K.main_text(f"<html>{head}</head><body>{svg}{article}</body></html>", chain) == text, svg
    for page in (f"<html>{head}{article}</html>", f"{head}\n{article}", f"{head}<body>{article}"):
        assert K.main_text(page, chain) == text, page
        assert all(x[0] != "head" for b in K.blocks(page) for x in b.path)
    assert [b.text for b in K.blocks(f"{head}<b>Bold</b> text<p>More")] == ["Bold text", "More"]
    assert [b.text for b in K.blocks(f"{head} bare text<p>More")] == ["bare text", "More"]


def test_viterbi_finds_the_best_path():
    import itertools

    from pressroom.llm.htmlcrf import Chain

    g = np.random.default_rng(3)
    c = Chain(["x"])
    for _ in range(20):
        c.t = g.normal(size=(2, 2))
        e = g.normal(size=(6, 2))
        value = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(c.t[a, b] for a, b in zip(y, y[1:]))
        assert abs(value(c.decode(e)) - max(value(y) for y in itertools.product((0, 1), repeat=6))) < 1e-9
