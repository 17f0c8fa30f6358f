"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps
its maximum over the window (after a rectifier), and a softmax layer gives language probabilities.
A text is cut into windows over its whole length; its probabilities are the mean over them,
weighted by their letters (bytes of letters and of non-ASCII characters).

Training uses a bounded sample: at most ``per_language`` different labelled texts of each language, the
first in the order of a hash of text (copies of a text take one place), and of each text a piece of
``PIECE`` characters at a hashed place.
The order of the sample fixes the random draws, so a run can be repeated.

Defined results: null text or text without a letter gives ``und`` with score 0; a null language is
never learnt from; a null id is carried through (and counts as held out); repeated rows get a row
each; extra columns are ignored; without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm.common import first_by_hash, held_out, read, slices, text_buffer

WINDOW, STEP, DIM, WIDTHS, FILTERS = 128, 125, 6, (2, 3, 4), 12
PIECE = 512
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class ByteCNN:
    def __init__(self, classes: list[str], seed: int = 5):
        g = np.random.default_rng(seed)
        self.classes = classes
        self.wide = max(WIDTHS)
        self.emb = g.normal(0, 0.5, (256, DIM)).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        self.w = g.normal(0, 1 / np.sqrt(DIM * 3), (self.wide * DIM, n)).astype(np.float32)
        self.mask = np.zeros_like(self.w)           # a filter of width k sees k embeddings
        for i, k in enumerate(WIDTHS):
            self.mask[: k * DIM, i * FILTERS: (i + 1) * FILTERS] = 1
        self.w *= self.mask
        self.b = np.zeros(n, np.float32)
        self.out = g.normal(0, 0.1, (n, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes -> (windows, places, wide * DIM) inputs of the filters."""
        e = np.ascontiguousarray(self.emb[x]).reshape(len(x), -1)
        s = e.strides
        return np.lib.stride_tricks.as_strided(
            e, (len(x), WINDOW - self.wide + 1, self.wide * DIM), (s[0], DIM * 4, 4), writeable=False)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(x), 256):
            c = self._columns(x[i: i + 256])
            z = (np.ascontiguousarray(c).reshape(-1, c.shape[2]) @ self.w).reshape(c.shape[0], c.shape[1], -1)
            h = np.maximum(z.max(axis=1) + self.b, 0)
            y = h @ self.out + self.bias
            y = np.exp(y - y.max(axis=1, keepdims=True))
            parts.append(y / y.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.empty((0, len(self.classes)), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 10, batch: int = 128,
              rate: float = 4e-3, seed: int = 6) -> None:
        g = np.random.default_rng(seed)
        names = ("emb", "w", "b", "out", "bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for _ in range(epochs):
            order = g.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i: i + batch]
                xb, yb = x[at], y[at]
                c = np.ascontiguousarray(self._columns(xb))
                z = (c.reshape(-1, c.shape[2]) @ self.w).reshape(c.shape[0], c.shape[1], -1)
                arg = z.argmax(axis=1)
                top = np.take_along_axis(z, arg[:, None, :], 1)[:, 0] + self.b
                h = np.maximum(top, 0)
                p = h @ self.out + self.bias
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p
                d[np.arange(len(yb)), yb] -= 1
                d *= (weight[at] / len(at))[:, None]
                dh = (d @ self.out.T) * (top > 0)
                seen = np.take_along_axis(c[:, :, None, :], arg[:, None, :, None], 1)[:, 0]    # batch, filters, inputs
                grads = {"out": h.T @ d, "bias": d.sum(0), "b": dh.sum(0),
                         "w": np.einsum("bf,bfi->if", dh, seen) * self.mask}
                back = dh[:, :, None] * self.w.T[None]                                         # batch, filters, inputs
                places = arg[:, :, None] + np.arange(self.wide)
                byte = xb[np.arange(len(xb))[:, None, None], places]
                de = np.zeros_like(self.emb)
                np.add.at(de, byte, back.reshape(*byte.shape, DIM))
                grads["emb"] = de
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
                    step = rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-7)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))


def windows(data: np.ndarray) -> np.ndarray:
    """The bytes of a text in rows of WINDOW, a row every STEP, the last filled with 0."""
    n = max(1, -(-max(len(data) - (WINDOW - STEP), 0) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(data)] = data[: len(padded)]
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (STEP, 1))


def fit(labelled: DataFrame, per_language: int = 400, text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """Train on at most ``per_language`` different texts of each language (PIECE characters of each)."""
    rows = labelled.where(f"{lang_col} is not null and {text_col} is not null").select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col), F.lit(3)).alias("h"),
        F.expr(f"substring({text_col}, cast(1 + pmod(xxhash64({text_col}), greatest(length({text_col}) - {PIECE}, 0) + 1) as int), {PIECE})").alias("piece"))
    # places go to texts, not rows; the pieces are picked for the texts that have one
    few = first_by_hash(rows.select("lang", "h").distinct(), "lang", "h", F.lit(per_language))
    few = rows.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    got = sorted((r.lang, r.h, r.piece) for r in few.collect())
    classes = sorted({g[0] for g in got})
    if not classes:
        return None
    g = np.random.default_rng(9)
    xs, ys = [], []
    for lang, _, piece in got:
        data = np.frombuffer(piece.encode(), np.uint8)
        w = windows(data).copy()
        for row in w[g.permutation(len(w))[:3]]:
            if g.random() < 0.25:                  # short texts occur
                row = row.copy()
                row[g.integers(8, WINDOW):] = 0
            if _LETTER[row].sum() >= 4:
                xs.append(row)
                ys.append(classes.index(lang))
    if not xs:
        return None
    x, y = np.array(xs), np.array(ys)
    share = np.bincount(y, minlength=len(classes)).astype(np.float32)
    net = ByteCNN(classes)
    net.train(x, y, (share.sum() / np.maximum(share, 1) / (share > 0).sum())[y])
    return net


def predict(docs: DataFrame, net: ByteCNN | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; the text stays."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "_letters")]
    if net is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 1 << 20):
            ok = b.column(b.schema.get_field_index("_letters")).to_pylist()
            buf, offs = text_buffer(b.column(b.schema.get_field_index(text_col)))
            langs, scores = ["und"] * len(ok), [0.0] * len(ok)
            at = [i for i, k in enumerate(ok) if k]
            if at:
                ws = [windows(buf[offs[i]: offs[i + 1]]) for i in at]
                x = np.concatenate(ws)
                p = net.probabilities(x)
                weight = _LETTER[x].sum(axis=1) + 1e-6
                begin = np.cumsum([0, *map(len, ws[:-1])])
                mean = np.add.reduceat(p * weight[:, None], begin) / np.add.reduceat(weight, begin)[:, None]
                for i, m in zip(at, mean):
                    k = int(m.argmax())
                    langs[i], scores[i] = net.classes[k], float(min(max(m[k], 0.0), 1.0))
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, letters.alias("_letters")).mapInArrow(run, schema + ", lang_pred string, score double")


def q_op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
