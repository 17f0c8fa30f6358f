"""Hard negatives: Strassen against direct products, heaps, and the whole operator against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("shape", [(1, 1, 1), (70, 64, 130), (101, 97, 33), (200, 200, 200), (40, 1, 90)])
def test_strassen(shape, monkeypatch):
    from pressroom.llm import hardneg

    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-2 ** 40, 2 ** 40, (m, k)), rng.integers(-2 ** 15, 2 ** 15, (k, n))
    for leaf in (1, 4, 32):
        monkeypatch.setattr(hardneg, "LEAF", leaf)
        assert (hardneg.strassen(a, b) == a @ b).all()


def test_share_is_exact():
    from pressroom.llm.hardneg import share

    for p in [0, 1, -1, 7, -7, 99, 2 ** 62 + 11, -(2 ** 62) - 5]:
        for num in (30, 90):
            assert int(share(np.array([p]), num, 100)[0]) == p * num // 100


def test_best_keeps_first_among_equals():
    from pressroom.llm.hardneg import best

    s = np.array([[5, 5, 5, 9, 5], [1, 2, 3, 4, 5]])
    ok = np.array([[True, False, True, True, True], [True, True, False, False, False]])
    r, c = best(s, ok, 3)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 1)]


def brute(rows, scale=256, n_pos=5, n_neg=10):
    ok = [(r, i, lab, [math.floor(scale * float(x)) for x in v]) for r, (i, v, lab) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(r, i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, q) for r, i, lab, q in ok]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for r, i, lab, q in ok:
        if i is None or i % 100:
            continue
        score = [(sum(a * b for a, b in zip(q, q2)), i2, r2, lab2) for r2, i2, lab2, q2 in ok if r2 != r]
        for p, pid, *_ in sorted([s for s in score if s[3] == lab], key=key)[:n_pos]:
            neg = sorted([s for s in score if s[3] != lab and 30 * p <= 100 * s[0] <= 90 * p], key=key)[:n_neg]
            out += [(i, pid, k + 1, s[1], p, s[0]) for k, s in enumerate(neg)]
    return sorted(out, key=str)


def mined(spark, rows, **kw):
    from pressroom.llm.hardneg import mine

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "'x' as row", "1 as unit", "2 as id", "false as anchor", "array(1) as vec").repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mine(df, label, F.col("vec_id") % 100 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_mine_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0.05, 0.2, 9))], int(rng.integers(0, 4))) for i in range(1200)]
    rows += [(5000 + i, rows[40][1], 2) for i in range(400)]                  # a third of the rows equal
    rows += [(6000, None, 1), (6100, [1.0] * 9, None), (None, [0.3] * 9, 1), (6200, [float("nan")] * 9, 1), (6300, [None] + [0.1] * 8, 1),
             (6400, [float("inf")] * 9, 2), (6500, [0.2, 0.1], 1), (6600, [], 1), (6700, [0.0] * 9, 1)]
    random.Random(2).shuffle(rows)
    want = brute(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want
    assert mined(spark, rows, group=3, cell=100) == want                       # many groups and cells
    assert mined(spark, rows, negatives=3, positives=1) == brute(rows, n_pos=1, n_neg=3)


def test_mine_edges(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [0.5], 2)]) == []                  # no anchor
    two = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [0.5, 0.5], 2), (101, [0.5, 0.5], 2)]
    assert mined(spark, two) == brute(two) and len(mined(spark, two)) == 4     # repeated rows
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(100, [3e12], 1), (101, [3e12], 1)])
