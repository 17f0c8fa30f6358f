"""The pipeline's stages: columns, whole input, decisions that take effect."""

import re

SF = "/root/testdata/sf0.001"


def test_stages_step_by_step(spark):
    import corpus_pipeline as P
    from pressroom.llm import decontam, jaccard, toxicity
    from pressroom.llm.common import read

    docs = read(spark, SF, "documents").cache()
    columns = docs.columns
    model = toxicity.learn(docs, read(spark, SF, "labels"))
    a = P.stage_toxicity(spark, docs, SF).cache()
    assert a.columns == columns
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()} - bad
    b = P.stage_ngram_join(spark, a, SF).cache()
    groups = {}
    for r in jaccard.similar(a).collect():
        groups.setdefault(r.component_id if r.n_shingles else ("none", r.id), []).append(r.id)
    assert b.columns == columns and sorted(r.doc_id for r in b.collect()) == sorted(min(v) for v in groups.values())
    c = P.stage_substring_dedup(spark, b, SF).cache()
    before = {r.doc_id: r for r in b.collect()}
    assert c.columns == columns and c.count() == len(before)
    seen = set()
    for r in sorted(c.collect(), key=lambda r: r.doc_id):
        w = re.findall(r"[^\x20\x09-\x0D]+", before[r.doc_id].text)
        repeats = any(tuple(w[i: i + 50]) in seen for i in range(len(w) - 49))
        assert repeats == (r.text != before[r.doc_id].text) and r.n_chars == len(r.text)
        seen |= {tuple(w[i: i + 50]) for i in range(len(w) - 49)}
    d = P.stage_decontaminate(spark, c, SF).cache()
    hit = {r.doc_id for r in decontam.decontaminate(c, read(spark, SF, "benchmark")).collect() if r.places}
    assert d.columns == columns and {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - hit
    e = P.stage_pack(spark, d, SF).collect()
    assert {r.doc_id for r in e} == {r.doc_id for r in d.collect()}
    got = P.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in got) == sorted((r.doc_id, r.start, r.ids_crc32) for r in e)


def test_odd_rows(spark):
    import corpus_pipeline as P

    rows = [(1, "same words here", "en", "s", 15), (1, "same words here", "en", "s", 15), (2, None, None, None, None), (None, "a lone text", None, "s", 11),
            (None, None, None, None, None), (3, "", "en", "s", 0), (4, "same words here", "en", "s", 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    b = P.stage_ngram_join(spark, df, SF)
    assert sorted(((r.doc_id, r.text) for r in b.collect()), key=str) == sorted([(1, "same words here"), (2, None), (None, "a lone text"), (None, None), (3, "")], key=str)
    c = P.stage_substring_dedup(spark, b, SF)
    assert sorted(((r.doc_id, r.text) for r in c.collect()), key=str) == sorted(((r.doc_id, r.text) for r in b.collect()), key=str)
    assert P.stage_decontaminate(spark, c, SF).count() == 5
    assert P.stage_pack(spark, c, SF).count() == 5
    none = df.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_one_id_on_two_unlike_texts(spark):
    import corpus_pipeline as P

    first, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, first), (2, first + " more"), (1, other), (3, other + " more"), (4, "a text like no other in the table")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in P.stage_ngram_join(spark, df, SF).collect())
    assert got == sorted([(1, first), (1, other), (4, rows[4][1])])
