"""Packing of documents into windows of at most N tokens by order-preserving dynamic programming.

The documents of an input split, in their order, form one stream of ids (each document's ids, then
an end id).  Cuts may fall at document ends (free), at sentence or line ends (a small penalty), and,
inside sentences too long to offer one, every ``grid`` ids (a larger penalty).  With p the position
of a cut candidate,

    cost(j) = penalty(j) + min over i with p(j) - p(i) <= N of  cost(i) + N - (p(j) - p(i))

so the transition is a minimum of cost(i) + p(i) over a sliding range of candidates, which a
monotone queue gives in constant amortised time.  The stream is solved in blocks: the best chain of a
block is kept up to its last cut and the ids after it open the next block, so memory is bounded by
a block and no window is closed early but the last of a split.

Each input split packs its own rows: no shuffle moves a text.  Window numbers are made gapless by
adding the number of windows of earlier splits (one row for each split).

Defined results: a null or empty text is one end id; repeated rows are packed as often as they
occur; a null id is carried through; extra columns are ignored; an empty table gives no rows; a
document longer than a window spans several.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.common import read, slices, stored

BLOCK = 1 << 20     # ids of a block


def best_cuts(pos: np.ndarray, pen: np.ndarray, window: int, last: bool) -> list[int]:
    """Indices into ``pos`` (increasing, pos[0] = 0, steps of at most ``window``) of the cheapest
    chain of cuts from 0; it ends at the last candidate, or if the stream goes on at the cheapest
    candidate within a window of it."""
    p, step = pos.tolist(), (pen + window).tolist()
    n = len(p)
    back = [0] * n
    key = [0.0] * n                 # cost + position, which grows by window + penalty from cut to cut
    q: deque[int] = deque([0])
    drop, pop, push = q.popleft, q.pop, q.append
    for j in range(1, n):
        low = p[j] - window
        i = q[0]
        while p[i] < low:
            drop()
            i = q[0]
        back[j] = i
        k = key[j] = key[i] + step[j]
        while q and key[q[-1]] >= k:
            pop()
        push(j)
    end = n - 1
    if not last:
        first = max(int(np.searchsorted(pos, pos[-1] - window)), 1)
        end = min(range(first, n), key=lambda j: key[j] - p[j])
    chain = [end]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return chain[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, grid: int,
               sentence_penalty: float, cut_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and their penalties."""
    pen = np.full(len(ids) + 1, np.inf)
    pen[np.flatnonzero(ends[ids]) + 1] = sentence_penalty
    pen[doc_ends] = 0
    pen[0] = 0
    pos = np.flatnonzero(np.isfinite(pen))
    gaps = np.diff(np.append(pos, len(ids)))
    for i in np.flatnonzero(gaps > grid):
        pen[np.arange(pos[i] + grid, pos[i] + gaps[i], grid)] = cut_penalty
    pen[len(ids)] = min(pen[len(ids)], cut_penalty)
    pos = np.flatnonzero(np.isfinite(pen))
    return pos, pen[pos]


class Stream:
    """Documents in, pieces out: (document number, start, length, window, offset, ids)."""

    def __init__(self, ends: np.ndarray, window: int, grid: int, sentence_penalty: float, cut_penalty: float):
        self.ends, self.window, self.args = ends, window, (grid, sentence_penalty, cut_penalty)
        self.docs: list[tuple[int, int, np.ndarray]] = []     # number, ids already placed, remaining ids
        self.held = self.windows = 0

    def add(self, number: int, ids: np.ndarray) -> None:
        self.docs.append((number, 0, ids))
        self.held += len(ids)

    def solve(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        stream = np.concatenate([d[2] for d in self.docs])
        doc_ends = np.cumsum([len(d[2]) for d in self.docs])
        pos, pen = candidates(stream, self.ends, doc_ends, *self.args)
        cuts = pos[best_cuts(pos, pen, self.window, last)]
        k, at = 0, 0            # document, position in the stream
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            while at < hi:
                number, done, ids = self.docs[k]
                begin = int(doc_ends[k]) - len(ids)
                stop = min(hi, int(doc_ends[k]))
                yield number, done + at - begin, stop - at, self.windows, at - lo, stream[at:stop]
                at = stop
                if at == doc_ends[k]:
                    k += 1
            self.windows += 1
        rest = self.docs[k:]
        if rest and at > int(doc_ends[k]) - len(rest[0][2]):
            number, done, ids = rest[0]
            gone = at - (int(doc_ends[k]) - len(ids))
            rest[0] = (number, done + gone, ids[gone:])
        self.docs, self.held = rest, int(sum(len(d[2]) for d in rest))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = True,
         grid: int = 64, sentence_penalty: float = 4.0, cut_penalty: float = 64.0,
         id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, the ids themselves.  The file's special tokens are ordinary text where a text holds
    their strings, or with ``special_tokens`` the ids that the file gives them."""
    grid = min(grid, window)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, "
              "local_id long, offset long" + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pressroom.llm.tokens import encoder

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, special_tokens)
        ends = enc.sentence_ends()
        if end_id >= len(ends):
            ends = np.append(ends, np.zeros(end_id + 1 - len(ends), bool))
        stream = Stream(ends, window, grid, sentence_penalty, cut_penalty)
        names: dict[int, tuple] = {}
        number = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            rows = [(*names[d], s, n, zlib.crc32(i.astype("<u4").tobytes()), w, o, i) for d, s, n, w, o, i in stream.solve(last)]
            live = {d[0] for d in stream.docs}
            for d in [d for d in names if d not in live]:
                del names[d]
            if not rows:
                return
            c = list(zip(*rows))
            cols = [pa.array(c[0], id_type), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()),
                    pa.array(c[1], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(c[5], pa.int64()),
                    pa.array(c[6], pa.int64())]
            if with_ids:
                flat = np.concatenate(c[7]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c[7])]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "part",
                                                         "local_id", "offset", *(["ids"] if with_ids else [])])

        id_type = None
        for b in slices(batches, text_col, 2 << 20):
            col = b.column(b.schema.get_field_index(id_col))
            id_type = col.type
            flat, stops = enc.encode_column(b.column(b.schema.get_field_index(text_col)))
            for i, lo, hi in zip(col.to_pylist(), np.append(0, stops[:-1]).tolist(), stops.tolist()):
                ids = np.append(flat[lo:hi], np.uint32(end_id))
                names[number] = (i, len(ids))
                stream.add(number, ids)
                number += 1
                if stream.held >= BLOCK:
                    yield from out(False)
        yield from out(True)

    pieces = stored(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces")
    per_part = pieces.groupBy("part").agg((F.max("local_id") + 1).alias("n"))
    base = per_part.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # one row for each input split: bounded by the number of tasks of the scan
    placed = pieces.join(F.broadcast(base), "part").withColumn("sequence_id", F.col("base") + F.col("local_id"))
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                         *(["ids"] if with_ids else []))


def q_op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False,
                special_tokens=True)
