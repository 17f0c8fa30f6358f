"""Substring, byte and set-similarity dedup and decontamination against brute force on small tables."""

import hashlib
import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def vocabulary(seed, n=60):
    g = random.Random(seed)
    return ["".join(g.choice("abcdeéß") for _ in range(g.randint(1, 6))) for _ in range(n)]


def corpus(seed=3):
    """Fresh prose, near copies, shared passages, runs and all the awkward rows."""
    g = random.Random(seed)
    v = vocabulary(seed, 400)
    fresh = lambda n: " ".join(g.choice(v) for _ in range(n))
    passage, other = fresh(70), fresh(55)
    texts = [fresh(g.randint(1, 160)) for _ in range(12)]
    base = fresh(220).split()
    for _ in range(8):                                   # near copies with a few edits each
        w = list(base)
        for _ in range(g.randint(0, 4)):
            w[g.randrange(len(w))] = g.choice(v)
        texts.append(" ".join(w))
    texts += [fresh(20) + " " + passage + " " + fresh(30), passage, fresh(3) + "\n\n" + passage.replace(" ", "\t", 5), other + " " + fresh(9) + " " + other]
    texts += ["spam " * 300, "spam " * 120, "a b " * 130, ("x y z w v. " * 40) + fresh(60), "", " \n ", "one", "One two", "one TWO"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (None, passage, None, "s", 0), (None, None, None, None, None)]
    rows += [rows[21], rows[21], (901, "Z" * 5000 + " " + fresh(50), "en", None, 1)]          # repeated rows; a very long word
    g.shuffle(rows)
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    # extra columns whose names the operators use themselves
    from pyspark.sql import functions as F

    return df.select("*", F.lit(1).alias("k"), F.lit("x").alias("id"), F.lit(2).alias("_k"), F.lit(3).alias("lo"), F.lit(4).alias("shard"))


def brute_words(rows, size=50):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        if i is not None:
            for p in range(len(w) - size + 1):
                x = tuple(w[p: p + size])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p: p + size])] < i:
                gone |= set(range(p, p + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup_brute_force(spark, seed):
    from pressroom.llm.substring import dedup

    rows = corpus(seed)
    got = dedup(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_words(rows)
    whole = {t for _, t, *_ in rows}
    for r in got:
        assert r.n_removed or r.kept in whole                    # untouched texts stay as they are
        assert " ".join(words_of(r.kept)) == r.kept or not r.n_removed


def test_recompression_equal_windows_get_equal_anchors():
    import numpy as np

    from pressroom.llm.common import U64, mix
    from pressroom.llm.recompress import anchors, levels

    g = np.random.default_rng(1)
    body = g.integers(0, 6, 400)
    body[100:160] = 3                                            # a long run
    seqs = [np.concatenate([g.integers(0, 6, 30), body, g.integers(0, 6, 20)]), np.concatenate([body, g.integers(0, 6, 9)])]
    told = []
    for s in seqs:
        names = np.concatenate([[99], s, [98]]).astype(U64)
        sep = names >= U64(50)
        names = mix(names + U64(1))
        for lv in levels(names, sep):
            assert (np.diff(lv.low) >= 0).all() and (np.diff(lv.high) >= 0).all()
        starts = np.arange(1, len(s) - 48)
        r, n, at = anchors(names, sep, starts, 50)
        assert ((at >= starts) & (at < starts + 50)).all()
        told.append({tuple(s[i - 1: i + 49]): (int(a), int(b), int(c - i)) for i, a, b, c in zip(starts, r, n, at)})
    shared = told[0].keys() & told[1].keys()
    assert len(shared) >= 300 and all(told[0][x] == told[1][x] for x in shared)


def brute_bytes(rows, size=200):
    count = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            count[b[p: p + size]] = count.get(b[p: p + size], 0) + 1
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p: p + size]] > 1:
                gone[p: p + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, k in zip(b, gone) if not k)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [2 << 20, 3000])
def test_byte_dedup_brute_force(spark, shard_bytes, monkeypatch):
    from pressroom.llm import bytededup

    monkeypatch.setattr(bytededup, "SHARD_BYTES", shard_bytes)   # small: names are cut over shards
    rows = corpus(5)
    got = bytededup.dedup_bytes(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute_bytes(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_array_and_common_prefixes():
    import numpy as np

    from pressroom.llm.suffixarray import common_prefixes, suffix_array

    g = np.random.default_rng(2)
    for text in (g.integers(0, 3, 700), np.zeros(600, int), np.tile([1, 2, 3], 200), g.integers(0, 255, 900), np.array([7])):
        t = text.astype(np.uint8)
        b = t.tobytes()
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = common_prefixes(t, sa, 50)
        for r in range(1, len(b)):
            x, y = b[sa[r - 1]:], b[sa[r]:]
            n = 0
            while n < min(len(x), len(y), 50) and x[n] == y[n]:
                n += 1
            assert lcp[r] == n


def test_suffix_array_sorts_one_number_a_round(monkeypatch):
    """The rounds of the refinement sort one 64-bit key, no three columns by stable sorts."""
    import numpy as np

    from pressroom.llm import suffixarray

    def refused(*x, **y):
        raise AssertionError("sorted by several columns")

    monkeypatch.setattr(suffixarray.np, "lexsort", refused)
    t = np.random.default_rng(3).integers(97, 100, 3000).astype(np.uint8)
    t[2000:] = t[:1000]
    b = t.tobytes()
    assert suffixarray.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_sets(rows):
    sets = []
    for _, t, *_ in rows:
        w = words_of((t or "").translate(AZ))
        sets.append({tuple(w[p: p + 5]) for p in range(max(len(w) - 4, 1))} if w else set())
    par = list(range(len(rows)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                par[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 6])
def test_ngram_join_brute_force(spark, seed):
    from pressroom.llm.jaccard import similar

    g = random.Random(seed)
    rows = corpus(seed)
    v = vocabulary(seed, 400)
    w = [g.choice(v) for _ in range(60)]
    for i in range(25):                                          # a chain: each a little off the one before
        w = list(w)
        w[g.randrange(len(w))] = g.choice(v)
        rows.append((2000 + i, " ".join(w), "en", "s", 0))
    got = similar(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_shingles, r.component_id) for r in got], key=str) == brute_sets(rows)


def test_ngram_join_without_star_rounds_agrees(spark):
    from pressroom.llm.jaccard import similar

    rows = corpus(7)
    a, b = (sorted([(r.id, r.component_id) for r in similar(frame(spark, rows), rounds=n).collect()], key=str) for n in (0, 2))
    assert a == b


def test_ngram_join_sets_of_one_passage_meet_once(spark, monkeypatch):
    """Texts that share a passage, which is not enough to link them: its shingles make one list for each group of
    the same texts, and two texts do not meet again in list after list."""
    from pressroom.llm import jaccard

    g = random.Random(11)
    v = vocabulary(11, 3000)
    fresh = lambda n: " ".join(g.choice(v) for _ in range(n))
    texts = [" ".join([fresh(g.randint(260, 300)), passage, fresh(5)]) for passage in (fresh(700), fresh(700)) for _ in range(12)]
    near = texts[0].split()
    near[3] = "other"
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, " ".join(near)])]
    met, lists = [], []
    told, kept = jaccard._met, jaccard._first_of_equal
    monkeypatch.setattr(jaccard, "_met", lambda *x: met.append(told(*x)) or met[0].localCheckpoint())
    monkeypatch.setattr(jaccard, "_first_of_equal", lambda x: lists.append([r.k for r in kept(x).groupBy("shingle").agg(
        F.sort_array(F.collect_list("k")).alias("k")).collect()]) or kept(x))
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "discard", lambda *x: None)
    got = jaccard.similar(frame(spark, rows)).collect()
    assert sorted([(r.id, r.n_shingles, r.component_id) for r in got], key=str) == brute_sets(rows)
    assert len(lists[0]) == len({tuple(x) for x in lists[0]})
    pairs = met[0].count()
    assert pairs and pairs <= 3 * met[0].distinct().count()


def brute_hits(rows, items, size=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = {}
    for i, t in items:
        w = norm(t)
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p: p + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t, *_ in rows:
        w = norm(t)
        hit, who = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p: p + n])) in windows:
                    hit |= set(range(p, p + n))
                    who |= windows[x]
        out.append((i, len(w), len(hit), sorted(who)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontaminate_brute_force(spark, bound, monkeypatch):
    from pressroom.llm import decontam

    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", bound)    # 0: the join by shuffle
    rows = corpus(8)
    long = max((t for _, t, *_ in rows if t), key=len)
    items = [(1, rows[5][1]), (2, "Spam spam, SPAM"), (3, "one"), (4, None), (5, "  "), (None, "one two"), (6, " ".join(words_of(long)[-14:])),
             (6, "nothing of this kind stands anywhere in the texts above, or does it"), (7, "x-y z; w v x y z w v")]
    df = spark.createDataFrame(items, "item_id long, text string")
    from pyspark.sql import functions as F

    got = decontam.decontaminate(frame(spark, rows), df).withColumn("n_hit", F.coalesce(decontam.hit_words(), F.lit(0))).collect()
    assert sorted([(r.doc_id, r.n_words, max(r.n_hit, 0), sorted(r["items"] or [])) for r in got], key=str) == brute_hits(rows, items)


def test_key_filter_keeps_texts_in_the_jvm(spark):
    """``without`` sends hashes to Python, no texts; a split with a step after it takes one Python worker for both."""
    import pyarrow as pa

    from pressroom.llm.common import KeyFilter, without

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "_k long, text string")
    keys = spark.createDataFrame([(i,) for i in (3, 7, 7, 200)], "k long")
    rest = without(docs, keys)
    assert sorted(r._k for r in rest.collect()) == [i for i in range(50) if i not in (3, 7)]
    assert "MapInArrow" not in rest._jdf.queryExecution().toString()

    def twice(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([2 * x for x in b.column(0).to_pylist()], pa.int64())], names=["x"])

    two = KeyFilter(keys).split(docs, True, "_k", twice, "x long")
    assert {6, 14} <= {r.x for r in two.collect()} <= {2 * i for i in range(50)}
    assert two._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def python_steps_in_a_task(df):
    """The most Python steps that stand one on the other without an exchange between them."""
    def walk(node, above):
        name = node.nodeName()
        above = 0 if "Exchange" in name else above + ("Python" in name or "Arrow" in name)
        below = node.children()
        return max([above, *(walk(below.apply(i), above) for i in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan(), 0)


@pytest.mark.parametrize("operator", ["substring", "bytededup"])
def test_a_task_has_one_python_worker(spark, monkeypatch, operator):
    """A task with two Python steps holds two workers, and an executor keeps them for all that follows."""
    import importlib

    module = importlib.import_module(f"pressroom.llm.{operator}")
    long = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"{i} {long} {i}" if i % 3 else f"lone {i}") for i in range(12)], "doc_id long, text string")
    most, stored = {}, module.stored

    def seen(df, name, **more):
        most[name] = python_steps_in_a_task(df)
        return stored(df, name, **more)

    monkeypatch.setattr(module, "stored", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")        # the plan with its exchanges, before it runs
    try:
        out = module.dedup(docs) if operator == "substring" else module.dedup_bytes(docs)
        most["out"] = python_steps_in_a_task(out)
        assert out.count() == 12
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most["settled"] == 1 and max(most.values()) == 1, most


def test_empty_tables(spark):
    from pressroom.llm import bytededup, decontam, jaccard, substring

    df = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring.dedup(df).count() == 0
    assert bytededup.dedup_bytes(df).count() == 0
    assert jaccard.similar(df).count() == 0
    assert decontam.decontaminate(df, items).count() == 0
    some = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    assert [r["items"] for r in decontam.decontaminate(some, items).collect()] == [None]
