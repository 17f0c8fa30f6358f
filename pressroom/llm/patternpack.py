"""Packing of documents into as few windows as possible by patterns of a few lengths.

A document is its ids and an end id; one longer than a window is cut into pieces of a whole window,
of which the first may be shorter.  Only the histogram of piece lengths (one count for each length up
to the window) decides how pieces share windows:

1. Patterns: all pairs and triples of occurring lengths whose sum is exactly a window.
2. Repeat counts: non-negative least squares, the smallest |A x - b| over x >= 0, where column p of A
   counts the lengths of pattern p and b is the histogram.  Solved by accelerated projected
   gradients (A has three entries a column, so a step costs a few passes over the patterns).
3. Rounding: patterns with the largest counts first, rounded up (or down) to what the histogram
   still holds.
4. Residual: what is left goes, longest first, into the fullest window that takes it, for all
   pieces of a length at once.

A length that a group of copies makes far more frequent than the others would draw all partners to
itself in step 2; so the fit is tried with the counts clipped at several multiples of their median
and the outcome with fewest windows stands.  All of this is bounded by the window length, whatever
the number of documents.

The plan is a list of slots "the pieces of length l with ranks r .. r + n - 1 go to windows w, w + 1 ...
at offset o".  A piece's rank among those of its length is its running number in its input split plus
the counts of earlier splits, so no text is shuffled, no group of equal lengths meets in one task, and
every piece looks its slot up.

Defined results: a null or empty text is one end id; repeated rows are packed as often as they
occur; a null id is carried through; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.common import read, slices, stored

MAX_PATTERNS = 1 << 17      # beyond it (windows over 1,254) triples of every k-th smallest length only
STEPS = 600                 # gradient steps of the fit
CLIPS = (np.inf, 4.0, 1.0, 0.25)     # clips of the histogram, in medians of its counts
RANKS = 44                  # bits of a rank in a look-up key


def patterns(lengths: np.ndarray, window: int, most: int = MAX_PATTERNS) -> np.ndarray:
    """Pairs and triples of occurring lengths that fill a window: rows (a, b, c), a <= b <= c, a = 0 for a pair."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = have[window] = False
    half = np.flatnonzero(have[: window // 2 + 1])
    half = half[have[window - half]]
    rows = [np.stack([np.zeros_like(half), half, window - half], 1)]
    small = np.flatnonzero(have[: window // 3 + 1])
    triples = [(b := np.arange(a, (window - a) // 2 + 1))[have[b] & have[window - a - b]] for a in small.tolist()]
    stride = max(1, -(-sum(map(len, triples)) // most))
    for a, b in zip(small[::stride].tolist(), triples[::stride]):
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows)


def fit(parts: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with least |A x - hist|: accelerated projected gradients with restarts."""
    def lengths(x: np.ndarray) -> np.ndarray:
        r = np.bincount(parts.ravel(), np.repeat(x, 3), len(hist))
        r[0] = 0
        return r

    def back(r: np.ndarray) -> np.ndarray:
        return r[parts[:, 0]] + r[parts[:, 1]] + r[parts[:, 2]]

    v, norm = np.ones(len(parts)), 1.0
    for _ in range(30):                                # largest eigenvalue of A'A by power iteration
        v = back(lengths(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    norm *= 1.05
    b = hist.astype(float)
    b[0] = 0
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(lengths(y) - b) / norm, 0)
        if np.dot(y - new, new - x) > 0:
            t, y = 1.0, new
        else:
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            y = new + (last - 1) / t * (new - x)
        x = new
    return x


class Plan:
    """Slots: (length, first rank, pieces, first window, offset, pieces of this slot in a window)."""

    def __init__(self, hist: np.ndarray, window: int):
        self.left, self.window = [int(n) for n in hist], window
        self.used = [0] * (window + 1)                 # ranks given out, by length
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.windows = 0

    def put(self, length: int, n: int, first: int, offset: int, per: int) -> None:
        self.slots.append((length, self.used[length], n, first, offset, per))
        self.used[length] += n
        self.left[length] -= n

    def repeat(self, parts: list[int], n: int) -> None:
        """n windows of a pattern, as far as the histogram has the pieces."""
        count = {p: parts.count(p) for p in parts}
        n = min(n, *(self.left[p] // k for p, k in count.items()))
        if n <= 0:
            return
        offset = 0
        for p, k in count.items():
            self.put(p, n * k, self.windows, offset, k)
            offset += p * k
        self.windows += n

    def rest(self) -> None:
        """What is left: longest first into the fullest window with room (best fit), by whole groups of
        windows with the same room."""
        size = self.window
        room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for p in range(size, 0, -1):
            s = p
            while self.left[p]:
                while s < size and not room[s]:
                    s += 1
                n = self.left[p]
                fits = s // p
                if s < size:
                    first, have = room[s].pop()
                else:                                  # new windows
                    first, have = self.windows, -(-n // fits)
                    self.windows += have
                full = min(have, n // fits)
                if full:
                    self.put(p, full * fits, first, size - s, fits)
                    room[s - fits * p].append((first, full))
                if full < have:
                    some = min(self.left[p], fits)     # fewer than fit: they share one window
                    if some:
                        self.put(p, some, first + full, size - s, some)
                        room[s - some * p].append((first + full, 1))
                    if have > full + bool(some):
                        room[s].append((first + full + bool(some), have - full - bool(some)))


def plan(hist: np.ndarray, window: int) -> Plan:
    """The plan with fewest windows over the clips and ways of rounding."""
    hist = hist.copy()
    hist[0] = 0
    least = -(-int((hist * np.arange(window + 1)).sum()) // window)
    some = np.flatnonzero(hist[:window])
    parts = patterns(some, window)
    best: Plan | None = None
    for clip in CLIPS if len(parts) else CLIPS[:1]:
        top = clip * float(np.median(hist[some])) if len(some) else np.inf
        if best is not None and (hist[:window] <= top).all():
            continue                                   # this clip changes nothing
        x = fit(parts, np.minimum(hist, top)) if len(parts) else np.empty(0)
        for rounded in (np.ceil(x), np.floor(x)):
            p = Plan(hist, window)
            p.repeat([window], int(hist[window]))
            order = np.argsort(-x, kind="stable")
            order = order[rounded[order] > 0]
            for a, n in zip(parts[order].tolist(), rounded[order].tolist()):
                p.repeat(a if a[0] else a[1:], int(n))
            p.rest()
            if best is None or p.windows < best.windows:
                best = p
        if best.windows <= least + least // 2000:
            break
    return best


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 2, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = True) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for,
    the ids.  Strings of the file's special tokens get the file's ids, or are ordinary text without
    ``special_tokens``."""
    if not 1 <= window < 1 << 16:
        raise ValueError("window must be between 1 and 65,535")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pressroom.llm.tokens import encoder

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, special_tokens)
        seen = np.zeros(window + 1, np.int64)          # pieces of each length so far
        end = np.array([end_id], np.uint32)
        for b in slices(batches, text_col, 2 << 20):
            ids = b.column(0)
            flat, stops = enc.encode_column(b.column(1))
            total = np.diff(np.append(0, stops)) + 1
            n = -(-total // window)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(piece == 0, 0, total[row] - (n[row] - piece) * window)
            length = np.where(piece == 0, total[row] - (n[row] - 1) * window, window)
            lo = (stops - total + 1)[row] + start      # ids of earlier rows have no end ids here
            last = piece == n[row] - 1
            sums, kept = np.empty(len(row), np.int64), []
            for k, (i, m, e) in enumerate(zip(lo.tolist(), length.tolist(), last.tolist())):
                got = np.append(flat[i: i + m - 1], end) if e else flat[i: i + m]
                sums[k] = zlib.crc32(got.astype("<u4", copy=False).tobytes())
                if with_ids:
                    kept.append(got)
            order = np.argsort(length, kind="stable")
            by = length[order]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
            np.add.at(seen, length, 1)
            cols = [ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums)]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()),
                                                     pa.array(np.concatenate(kept).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                                             names=[*names, "_part", "_nth"])

    pieces = stored(docs.select(id_col, text_col).mapInArrow(cut, schema + ", _part int, _nth long"), "pieces")
    per_part = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    hist = np.zeros(window + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect():      # at most ``window`` rows
        hist[r["length"]] = r["n"]
    made = plan(hist, window) if hist.any() else Plan(hist, window)
    slots = np.array(sorted(made.slots), np.int64).reshape(-1, 6)
    sent = docs.sparkSession.sparkContext.broadcast(slots)     # bounded by the number of patterns

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, ["_part", "length"]).select(*names, (F.col("_base") + F.col("_nth")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, windows, offset, per = sent.value.T
        keys = (length << RANKS) + first
        for b in batches:
            m, rank = b.column(3).to_numpy(), b.column(len(names)).to_numpy()
            at = np.searchsorted(keys, (m << RANKS) + rank, "right") - 1
            nth = rank - first[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(windows[at] + nth // per[at]),
                                              pa.array(offset[at] + nth % per[at] * m)],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def q_op11_pattern_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
