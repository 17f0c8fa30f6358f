"""Toxicity by compression distance.

Two zstandard dictionaries share a part trained on ordinary text; one of them also holds the
segments that toxic text has and ordinary text lacks, the other holds zeros in their place.  A text
is normalised (lower case, anything but letters and digits becomes one space) and cut at spaces into
windows over its whole length; each is compressed with either dictionary.  A window that the toxic
dictionary compresses to fewer bytes is evidence.  Counts and rates of windows by saved bytes go
through a logistic curve calibrated on labelled texts, so that 0.5 is the decision threshold.

Toxic segments are word beginnings that toxic text has in many different surroundings (counted by
the word before, so that copies of one text count once) at a rate far above that of ordinary text.

Training uses a bounded sample: at most ``toxic_rows`` and ``ordinary_rows`` labelled rows, the first
by a hash of the text, and of each a piece of ``PIECE`` characters at a hashed place.

Defined results: a null or empty text has no window and gets the score of no evidence; a null id is
carried through (it counts as held out); labels that are null or neither 0 nor 1 are not learnt from;
a doc_id labelled twice is learnt twice; repeated rows get a row each; extra columns are ignored; if
either label is missing every score is 0.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm.common import first_by_hash, held_out, read

WINDOW, PIECE = 96, 4096
TOXIC_WORTH = 2.0       # a missed toxic text weighs as much as so many wrongly rejected ones
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" "


def windows(data: bytes) -> list[bytes]:
    out, i, n = [], 0, len(data)
    if n <= 2:
        return out
    while i < n:
        j = min(i + WINDOW, n)
        if j < n:
            k = data.rfind(b" ", i + WINDOW // 2, j)
            j = k if k > 0 else j
        out.append(data[i:j])
        i = j
    return out


def segments(toxic: list[bytes], ordinary: list[bytes], most: int = 400) -> list[bytes]:
    """Word beginnings (up to the whole word and its space) over-represented in toxic text."""
    def seen(texts, lengths, only=None):
        by = defaultdict(set)
        for t in texts:
            ws = t.split()
            for left, w in zip([b"", *ws], ws):
                w += b" "
                for k in lengths:
                    if k <= len(w) and (only is None or w[:k] in only):
                        by[w[:k]].add(hash(left))
        return {g: len(s) for g, s in by.items()}

    # one length at a time, and of ordinary text only what may be chosen: few sets are held at once
    need = max(4, 0.003 * len(toxic))
    t = {g: n for k in range(4, 15) for g, n in seen(toxic, [k]).items()}
    o = seen(ordinary, range(4, 15), {g for g, n in t.items() if n >= need})
    a, b = sum(map(len, toxic)) or 1, sum(map(len, ordinary)) or 1

    def surplus(g):
        e = (t[g] + o.get(g, 0)) * a / (a + b)
        return (t[g] - e) / math.sqrt(e + 1e-9)

    chosen = {g for g, n in t.items() if n >= need and n / a >= 12 * (o.get(g, 0) + 0.5) / b and surplus(g) > 4}
    shortest = sorted((g for g in chosen if not any(g[:k] in chosen for k in range(4, len(g)))), key=lambda g: (-surplus(g), g))
    longer = defaultdict(list)
    for g in t:
        longer[g[:-1]].append(g)
    out = []
    for g in shortest[:most]:
        while more := [h for h in longer[g] if t[h] >= 0.6 * t[g]]:
            g = more[0]
        out.append(g)
    return out


@dataclass
class Model:
    toxic: bytes            # contents of the two dictionaries
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def compressors(toxic: bytes, ordinary: bytes) -> tuple:
    import zstandard as z

    def make(content: bytes):
        params = z.ZstdCompressionParameters.from_level(
            3, window_log=17, hash_log=17, chain_log=17, strategy=z.STRATEGY_LAZY2, min_match=5,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return z.ZstdCompressor(dict_data=d, compression_params=params).compress

    return make(ordinary), make(toxic)


def features(text: str, plain, toxic) -> np.ndarray:
    ws = windows(normal(text))
    saved = np.array([len(plain(w)) - len(toxic(w)) for w in ws] or [0], float)
    saved.sort()
    n = len(saved)
    over = np.array([(saved >= k).sum() for k in (1, 2, 3, 4, 6)], float)
    under = np.array([(saved <= -k).sum() for k in (1, 2)], float)
    return np.concatenate([[saved[-1], saved[-3:].mean(), saved[-1] >= 3, saved[-1] >= 5, saved.mean(), math.log(n),
                            saved[0], saved[:3].mean()], over / n, np.log1p(over), np.log1p(under)])


def scores(model: Model, f: np.ndarray) -> np.ndarray:
    x = np.column_stack([(f - model.mean) / model.scale, np.ones(len(f))])
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def fit(labelled: DataFrame, toxic_rows: int = 1500, ordinary_rows: int = 3000, text_col: str = "text",
        label_col: str = "toxic") -> Model | None:
    """Train on at most toxic_rows + ordinary_rows rows of (text, 0/1), PIECE characters of each."""
    import zstandard as z

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(label_col).alias("y"), F.xxhash64(F.col(text_col), F.lit(4)).alias("h"),
        F.expr(f"substring({text_col}, cast(1 + pmod(xxhash64({text_col}), greatest(length({text_col}) - {PIECE}, 0) + 1) as int), {PIECE})").alias("piece"))
    few = first_by_hash(rows, "y", "h", F.when(F.col("y") == 1, toxic_rows).otherwise(ordinary_rows))
    got = sorted((int(r.y), r.h, r.piece) for r in few.collect())
    y = np.array([g[0] for g in got])
    if not len(y) or y.min() == y.max():
        return None
    texts = [normal(g[2]) for g in got]
    toxic, ordinary = [t for t, k in zip(texts, y) if k], [t for t, k in zip(texts, y) if not k]
    special = b"\0".join([b"", *(b" " + g for g in reversed(segments(toxic, ordinary))), b""])
    try:
        shared = z.train_dictionary(16384, [t[i: i + 256] for t in ordinary for i in range(0, len(t), 256)]).as_bytes()
    except z.ZstdError:                    # too little text for the trainer: the text itself
        shared = b"".join(ordinary)[:16384]
    content = special + shared, bytes(len(special)) + shared
    plain, tox = compressors(*content)
    f = np.array([features(g[2], plain, tox) for g in got])
    mean, scale = f.mean(0), f.std(0) + 1e-6
    x = np.column_stack([(f - mean) / scale, np.ones(len(f))])
    w = np.zeros(x.shape[1])
    worth = np.where(y == 1, TOXIC_WORTH, 1.0)
    for _ in range(30):                    # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (worth * (p - y)) + 0.3 * w
        hess = (x * (worth * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w -= np.linalg.solve(hess, g)
    return Model(*content, mean, scale, w)


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns score and predicted; everything else stays."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plain, tox = compressors(model.toxic, model.ordinary)
        for col in texts:                  # one text at a time is held as a Python string
            f = [features(x.as_py() or "", plain, tox) for x in col]
            yield pa.array(scores(model, np.array(f)) if f else [], pa.float64())

    rate.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # only the text goes to Python and only its score comes back
    rated = docs.select(*keep, F.arrow_udf(rate, "double")(F.col(text_col)).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, ordinary_rows: int = 3000) -> Model | None:
    """The model of the labelled documents that are not held out.  The sample is drawn from the
    labels alone, by a hash of the id; it is bounded, so it goes to the documents as a broadcast."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    labels = labels.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(4)).alias("_h"))
    few = first_by_hash(labels, "toxic", "_h", F.when(F.col("toxic") == 1, toxic_rows).otherwise(ordinary_rows))
    return fit(docs.select("doc_id", "text").join(F.broadcast(few.drop("_h")), "doc_id"), toxic_rows, ordinary_rows)


def q_op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
