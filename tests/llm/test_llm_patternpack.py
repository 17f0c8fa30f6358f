"""Pattern packing: round trip of the ids, places, the number of windows; the chunk encoder against the tokenizer."""

import random
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def checked(rows, got, tok, window, end_id):
    """Pieces against the tokenizer's ids of every text, windows without gap or overlap; the number of windows."""
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [end_id])
    assert set(by) == set(want)
    for i, texts in want.items():
        whole = {}
        for ids in texts:                               # repeated ids: as many pieces of each kind
            n = -(-len(ids) // window)
            cuts = [0] + [len(ids) - (n - 1 - k) * window for k in range(n)]
            for k in range(n):
                part = ids[cuts[k]: cuts[k + 1]]
                key = (k, cuts[k], len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
                whole[key] = whole.get(key, 0) + 1
        have = {}
        for r in by[i]:
            key = (r.piece, r.start, r.length, r.ids_crc32)
            have[key] = have.get(key, 0) + 1
        assert have == whole, i
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(seq)


def test_pattern_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pressroom.llm.patternpack import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    random.seed(3)
    texts = ["", None, "a", "Hello  two spaces. <|endoftext|> And more!", " lead", "trail ", "tab\t x\n\n y", "é" * 500, "word " * 9000,
             "x" * 20000, "  　", "same text.", "same text.", "line\nline\nline"] + ["w" + " w" * random.randint(0, 90) for _ in range(300)]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "'z' as _part", "2 as length").repartition(3)
    got = pack(df, path, window=64).collect()
    tok = Tokenizer.from_file(path)
    n = checked(rows, got, tok, 64, 2)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32 and len(r["ids"]) == r.length
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert n <= -(-total // 64) + 2
    assert pack(df.limit(0), path).count() == 0
    tok.encode_special_tokens = True
    got = pack(df, path, window=1, with_ids=False, special_tokens=False).collect()
    assert checked(rows, got, tok, 1, 2) == len(got)


def test_pattern_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pressroom.llm.patternpack import q_op11_pattern_pack

    got = q_op11_pattern_pack(spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n = checked(rows, got, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 1024, 2)
    assert n <= 1.01 * sum(r.length for r in got) / 1024 + 2


def best_fit(hist, window):
    """Windows of plain best fit, longest first."""
    room = []
    for p in range(window, 0, -1):
        for _ in range(int(hist[p])):
            fits = [k for k, s in enumerate(room) if s >= p]
            if fits:
                room[min(fits, key=lambda k: room[k])] -= p
            else:
                room.append(window - p)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_best_fit_and_bound(seed):
    from pressroom.llm.patternpack import plan

    rng = np.random.default_rng(seed)
    window = int(rng.choice([7, 32, 100]))
    hist = rng.integers(0, 9, window + 1) * (rng.random(window + 1) < 0.8)
    if seed % 2:
        hist[int(rng.integers(1, window))] = 200         # a group of copies
    p = plan(hist, window)
    hist[0] = 0
    fill, used = np.zeros(p.windows, int), np.zeros(window + 1, int)
    for length, rank, n, first, offset, per in p.slots:
        assert rank == used[length]
        used[length] += n
        np.add.at(fill, first + np.arange(n) // per, length)
    assert (used == hist).all() and fill.max() <= window and fill.min() > 0
    assert -(-int((hist * np.arange(window + 1)).sum()) // window) <= p.windows <= best_fit(hist, window)


def test_fit_reaches_an_exact_solution():
    from pressroom.llm.patternpack import fit, patterns

    window = 40
    parts = patterns(np.arange(1, window), window)
    assert (parts.sum(1) == window).all() and len(np.unique(parts, axis=0)) == len(parts)
    x = np.random.default_rng(0).integers(0, 5, len(parts)).astype(float)
    hist = np.bincount(parts.ravel(), np.repeat(x, 3), window + 1)
    hist[0] = 0
    got = fit(parts, hist, 3000)
    back = np.bincount(parts.ravel(), np.repeat(got, 3), window + 1)
    assert (got >= 0).all() and np.abs(back - hist)[1:].max() < 0.5


def test_chunk_encoder_equals_tokenizer(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pressroom.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    random.seed(1)
    pool = list("aZé 's\n\t  .,0Ü—") + [" ", "　", "  ", "\n\n", " \n", "\n ", "«", "\x1c", "\x85", "\r\n", "don't", "<|endoftext|>", "😀", "x" * 70, " " + "y" * 80]
    texts = ["".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(4000)] + ["", "long " * 30_000 + "é" * 100_000]
    full = Tokenizer.from_file(path)
    want = [full.encode(t, add_special_tokens=False).ids for t in texts]
    for run in (tokens.RUN_BYTES, 50):
        monkeypatch.setattr(tokens, "RUN_BYTES", run)
        enc = tokens.Encoder(path, True)
        got = [x for i in range(0, len(texts), 500) for x in enc.encode(texts[i: i + 500])]
        assert [x.tolist() for x in got] == want
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 100)      # emptied again and again
    enc = tokens.Encoder(path, True)
    assert [x.tolist() for i in range(0, len(texts), 100) for x in enc.encode(texts[i: i + 100])] == want
