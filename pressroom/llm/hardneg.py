"""Hard negatives by exact integer inner products: Strassen tiles, positive heaps, window heaps.

Each component x becomes floor(scale * x); a score is the integer inner product.  For each anchor the
first ``positives`` other rows of its label (higher scores first, ties by smaller id) are its
positives; for each of these, the first ``negatives`` rows of another label whose score lies between
two fractions of the positive's score are its hard negatives.

Anchors are dealt into groups of bounded size and all rows into cells, by hashes of a row number; each
(anchor group, cell) is a task's unit of work that streams the cell's rows in blocks past the group.
The scores of a block are the product of two int64 matrices by Strassen's recursion: seven products of
half the size, zero rows and columns where a size is odd, and additions only.  Additions, subtractions
and products of 64-bit integers are exact modulo 2**64, so the result is exact whenever the scores
themselves fit (checked for every block; else an OverflowError).  A block's scores are kept
only as heaps (the best few for an anchor, or for an anchor and a positive's window), which merge over
blocks in a task and over cells by a ranked window of a few rows for each cell.  Two rounds: windows
are known when the positives are.  No label, id or copy is a key of a shuffle, so a label or a group of
equal vectors with a third of the rows meets nowhere in one task.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part; a shorter vector counts as padded with zeros; rows with equal ids are rows of their own; equal
scores and ids are ordered by row; a null id is no anchor and comes last among ties; without
positives or negatives an anchor has no rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.common import read, stored

LEAF = 32                   # matrices with a side up to this are multiplied directly
BLOCK = 2048                # rows of a cell that are multiplied at once
GROUP = 8192                # anchors of a group, fewer for long vectors
GROUP_BYTES = 8 << 20
LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for int64 matrices, exact modulo 2**64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    m2, k2, n2 = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m2, 2 * n2), np.int64)
    out[:m2, :n2] = p1 + p4 - p5 + p7
    out[:m2, n2:] = p3 + p5
    out[m2:, :n2] = p2 + p4
    out[m2:, n2:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def share(p: np.ndarray, num: int, den: int) -> np.ndarray:
    """floor(p * num / den) without leaving 64 bits (0 <= num <= den)."""
    return p // den * num + p % den * num // den


def best(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest allowed scores of each row, earlier columns first among equals."""
    many = np.flatnonzero(ok.sum(1) > k)
    if len(many):
        s = np.where(ok[many], scores[many], LOWEST)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        over, tied = ok[many] & (s > kth), ok[many] & (s == kth)
        ok = ok.copy()
        ok[many] = over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(1)[:, None]))
    return np.nonzero(ok)


class Heaps:
    """The k best (score, id, row) for each of ``n`` slots, in arrays; ids as (is null, id)."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, LOWEST)
        self.cols = [np.empty(0, np.int64) for _ in range(5)]      # slot, score, null id, id, row

    def add(self, slot: np.ndarray, score: np.ndarray, null: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        c = [np.concatenate(x) for x in zip(self.cols, (slot, score, null, ident, row))]
        order = np.lexsort((c[4], c[3], c[2], -c[1], c[0]))
        c = [x[order] for x in c]
        rank = np.arange(len(order)) - np.searchsorted(c[0], c[0])
        self.cols = [x[rank < self.k] for x in c]
        full = rank == self.k - 1
        self.least[c[0][full]] = c[1][full]


class Cell:
    """One group of anchors against the rows of one cell."""

    def __init__(self, k: int, low: tuple[int, int] | None, high: tuple[int, int] | None):
        self.k, self.low, self.high, self.parts, self.heaps = k, low, high, [], None

    def anchors(self, rows: dict) -> None:
        self.parts.append(rows)

    def close(self) -> None:
        """All anchors are here: the windows of their positives, and empty heaps."""
        self.row, self.label = (np.concatenate([p[x] for p in self.parts]) for x in ("row", "label"))
        self.vec = matrix([p["vec"] for p in self.parts])
        n = len(self.row)
        if self.low is None:
            self.heaps = [Heaps(n, self.k)]
            return
        pos = matrix([p["pos"] for p in self.parts])
        have = np.concatenate([np.diff(p["pos"][1]) for p in self.parts])
        self.lo, self.hi = -share(-pos, *self.low), share(pos, *self.high)
        self.lo[np.arange(pos.shape[1]) >= have[:, None]] = np.iinfo(np.int64).max
        self.heaps = [Heaps(n, self.k) for _ in range(pos.shape[1])]

    def block(self, rows: dict) -> None:
        if not self.parts:
            return
        if self.heaps is None:
            self.close()
        order = np.lexsort((rows["row"], rows["id"], rows["null"]))
        vec = matrix([rows["vec"]])[order]
        row, label, null, ident = (rows[x][order] for x in ("row", "label", "null", "id"))
        d = max(vec.shape[1], self.vec.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (self.vec, vec))
        if d and max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) * d >= 1 << 63:
            raise OverflowError("inner products of these components may not fit in 64 bits")
        s = strassen(a, b.T) if d else np.zeros((len(a), len(b)), np.int64)
        same = self.label[:, None] == label
        for j, heap in enumerate(self.heaps):
            ok = s >= heap.least[:, None]
            if self.low is None:
                ok &= same & (self.row[:, None] != row)
            else:
                ok &= ~same & (s >= self.lo[:, j, None]) & (s <= self.hi[:, j, None])
            at, col = best(s, ok, self.k)
            heap.add(at, s[at, col], null[col], ident[col], row[col])

    def out(self) -> Iterator[pa.RecordBatch]:
        for j, heap in enumerate(self.heaps or []):
            slot, score, null, ident, row = heap.cols
            if len(slot):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(self.row[slot]), pa.array(np.full(len(slot), j, np.int32)), pa.array(score),
                     pa.array(ident, mask=null.astype(bool)), pa.array(row)],
                    names=["anchor", "j", "score", "id", "row"])


def matrix(lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows of (values, offsets) lists as one matrix, shorter ones padded with zeros."""
    n = np.concatenate([np.diff(o) for _, o in lists])
    flat = np.concatenate([v[o[0]: o[-1]] for v, o in lists])
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict]]:
    """(unit, kind, columns) for runs of at most BLOCK rows of input sorted by unit and kind."""
    held: list[pa.RecordBatch] = []
    key, n = None, 0

    def made() -> tuple[int, int, dict]:
        t = pa.Table.from_batches(held).combine_chunks()
        col = {c: t[c].chunk(0) for c in t.column_names}
        lists = lambda c: (col[c].values.to_numpy(), col[c].offsets.to_numpy())
        return (*key, {"row": col["row"].to_numpy(), "label": col["label"].to_numpy(), "vec": lists("vec"), "pos": lists("pos"),
                       "id": col["id"].fill_null(0).to_numpy(), "null": col["id"].is_null().to_numpy(False).astype(np.int64)})

    for b in batches:
        if not b.num_rows:
            continue
        unit, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((unit[1:] != unit[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            this = int(unit[lo]), int(kind[lo])
            while lo < hi:
                if held and (this != key or n >= BLOCK):
                    yield made()
                    held, n = [], 0
                take = min(hi - lo, BLOCK - n)
                held.append(b.slice(lo, take))
                key, n, lo = this, n + take, lo + take
    if held:
        yield made()


def tiles(rows: DataFrame, anchors: DataFrame, groups: int, cells: int, k: int, low: tuple[int, int] | None = None,
          high: tuple[int, int] | None = None) -> DataFrame:
    """The heaps of all units: (anchor, j, score, id, row)."""
    at = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n))
    some = F.array().cast("array<bigint>")
    cols = ["unit", "kind", "row", "id", "label", "vec", "pos"]
    left = anchors.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    left = left.withColumn("unit", at(groups, 1) * cells + F.col("cell")).withColumn("kind", F.lit(0))
    right = rows.withColumn("pos", some).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = right.withColumn("unit", F.col("group") * cells + at(cells, 2)).withColumn("kind", F.lit(1))
    both = left.select(*cols).unionByName(right.select(*cols))
    parts = min(groups * cells, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups * cells // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, unit = None, None
        for this, kind, cols in units(batches):
            if this != unit:
                if cell is not None:
                    yield from cell.out()
                cell, unit = Cell(k, low, high), this
            if kind == 0:
                cell.anchors(cols)
            else:
                cell.block(cols)
        if cell is not None:
            yield from cell.out()

    return both.repartition(parts, "unit").sortWithinPartitions("unit", "kind").mapInArrow(
        run, "anchor long, j int, score long, id long, row long")


def mine(rows: DataFrame, label: Column, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
         positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
         group: int = GROUP, cell: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).  ``label`` and ``anchor``
    are columns of ``rows``: an integer class and whether the row is an anchor."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    ready = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v"),
                        F.coalesce(anchor, F.lit(False)).alias("anchor"), finite.alias("ok"))
    ready = ready.where("label is not null and v is not null and ok").select(
        F.monotonically_increasing_id().alias("row"), "id", "label", "anchor",
        F.transform("v", lambda v: F.floor(v.cast("double") * scale)).alias("vec"))
    ready = stored(ready, "vectors")                    # the row numbers stay what they are
    size = ready.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("vec")).alias("d")).first()
    per_group = max(1, min(group, GROUP_BYTES // (8 * max(1, size["d"] or 1))))
    groups = max(1, -(-size["a"] // per_group))
    cells = max(1, -(-size["n"] // (cell or max(BLOCK, min(1 << 18, size["n"] // 64)))))

    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    anchors = ready.where("anchor")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    found = tiles(ready, anchors.withColumn("pos", F.array().cast("array<bigint>")), groups, cells, positives)
    pos = stored(found.withColumn("j", rank - 1).where(F.col("j") < positives).select(
        "anchor", "j", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    few = F.transform(F.sort_array(F.collect_list(F.struct("j", "positive_score"))), lambda p: p["positive_score"])
    few = pos.groupBy("anchor").agg(few.alias("pos")).withColumnRenamed("anchor", "row")       # at most ``positives`` each
    found = tiles(ready, anchors.join(few, "row"), groups, cells, negatives, low, high)
    rank = F.row_number().over(Window.partitionBy("anchor", "j").orderBy(*order))
    neg = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (neg.join(pos, ["anchor", "j"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def q_op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, label, F.col("vec_id") % 100 == 0)


def sql_op13() -> str:
    return """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, id AS positive_id, br AS pr, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, br) <= 5),
n AS (SELECT s.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY s.ar, p.pr ORDER BY s.score DESC, s.id NULLS LAST, s.br) AS k
      FROM s JOIN p USING (ar)
      WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, k::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10"""
