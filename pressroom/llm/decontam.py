"""Benchmark decontamination by winnowing.

A window is ``size`` consecutive words (an item of fewer words is one window of its own length).
The fingerprint of a window is the smallest hash of its ``k``-word grams; equal windows have equal
fingerprints, so every shared span of ``size`` words or more is found.  Fingerprints of the items
are joined with those of the documents; the join also compares a 128-bit digest of the window's
words, which extends a fingerprint hit to the whole window.  A bitmap of the items' fingerprints
(of fixed size, whatever the number of items) goes to the tasks that read the documents, so that
only windows that may hit leave them; each document sends a window once, with all its places.

Defined results: a null or empty text, or one without words, has no words and no windows; repeated
rows get a row each; a null id is kept; a null item_id counts as an item named ''; extra columns are
ignored; with no items nothing is hit; with no documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm.common import (ALNUM, LOWER, LOWER_AZ, U64, UPPER_AZ, digest16, doc_key, gram_hashes, join_keys,
                                  mix, read, row_of, slices, span_hashes, spaced, stored, words)

BITS = 24                       # log2 of the bits in the bitmap: 2 MB
BROADCAST_WINDOWS = 200_000     # up to so many item windows (about 10 MB) the exact join broadcasts them


def fingerprints(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each n consecutive words the smallest hash of their k-grams (k = n if n is smaller)."""
    g = gram_hashes(h, min(n, k))
    m = max(len(h) - n + 1, 0)
    out = g[:m].copy()
    for j in range(1, n - min(n, k) + 1):
        np.minimum(out, g[j: j + m], out=out)
    return mix(out ^ U64(n))


def _rows(batch: pa.RecordBatch, text: str):
    buf, offs = spaced(batch.column(batch.schema.get_field_index(text)))
    buf = LOWER[buf]
    s, e = words(buf, ALNUM)
    return buf, s, e, row_of(s, offs), span_hashes(buf, s, e)


def _digest(buf: np.ndarray, s: np.ndarray, e: np.ndarray, i: int, n: int) -> bytes:
    return digest16(b" ".join(buf[a:b].tobytes() for a, b in zip(s[i: i + n], e[i: i + n])))


def item_windows(items: DataFrame, size: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, fp, n, digest), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            ids = b.column(0).to_pylist()
            buf, s, e, row, h = _rows(b, text_col)
            count = np.bincount(row, minlength=len(ids))
            begin = np.concatenate([[0], np.cumsum(count)])
            out = []
            for r, i in enumerate(ids):
                n = min(size, int(count[r]))
                if n:
                    fp = fingerprints(h[begin[r]: begin[r + 1]], n, k)
                    out += [(i, int(f), n, _digest(buf, s, e, int(begin[r]) + j, n)) for j, f in enumerate(fp.astype(np.int64))]
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()),
                                                  pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())],
                                                 names=["item", "fp", "n", "digest"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col))
    return named.mapInArrow(run, "item string, fp long, n int, digest binary").distinct()


def _document_windows(docs: DataFrame, lengths: list[int], bitmap: np.ndarray, k: int, text_col: str) -> DataFrame:
    """A head row for each document (n_words set) and a row for each distinct window that may hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            keys, ids = b.column(0).to_numpy(), b.column(1)
            buf, s, e, row, h = _rows(b, text_col)
            count = np.bincount(row, minlength=len(keys))
            none = len(keys)
            found: dict[tuple, list] = {}
            for n in lengths:
                fp = fingerprints(h, n, k)
                at = (fp >> U64(64 - BITS)).astype(np.int64)
                hit = (bitmap[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
                hit &= row[: len(fp)] == row[n - 1: n - 1 + len(fp)]
                first = np.concatenate([[0], np.cumsum(count)])
                for i in np.flatnonzero(hit).tolist():
                    r = int(row[i])
                    found.setdefault((r, int(fp[i].astype(np.int64)), n, _digest(buf, s, e, i, n)), []).append(i - int(first[r]))
            f = list(found)
            take = pa.array(list(range(none)) + [x[0] for x in f], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()).take(take), ids.take(take),
                 pa.array(count.tolist() + [None] * len(f), pa.int64()),
                 pa.array([None] * none + [x[1] for x in f], pa.int64()),
                 pa.array([None] * none + [x[2] for x in f], pa.int32()),
                 pa.array([None] * none + [x[3] for x in f], pa.binary()),
                 pa.array([None] * none + list(found.values()), pa.list_(pa.int32()))],
                names=["_k", "_id", "n_words", "fp", "n", "digest", "starts"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_k long, _id {kind}, n_words long, fp long, n int, digest binary, starts array<int>")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, k: int = 6, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: _k (doc_key), id, n_words, the hit places (array of struct<start, n>) and the items."""
    tests = stored(item_windows(items, size, k, item_id, item_text), "items")
    bit = F.shiftrightunsigned("fp", 64 - BITS)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITS}) & 63 as int))")
    bits = tests.select(F.shiftright(bit, 6).alias("w"), mask.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    got = bits.toArrow()                                     # at most 2 ** (BITS - 6) rows
    bitmap = np.zeros(1 << (BITS - 6), U64)
    bitmap[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.int64).view(U64)
    lengths = sorted(r.n for r in tests.select("n").distinct().collect())     # at most ``size`` rows

    rows = docs.select(doc_key(id_col, text_col).alias("_k"), F.col(id_col).alias("_id"), F.col(text_col))
    found = stored(_document_windows(rows, lengths, bitmap, k, text_col), "windows")
    windows = tests.select("fp", "digest", "n").distinct()
    small = windows.count() <= BROADCAST_WINDOWS
    hits = stored(found.where("fp is not null").drop("n_words").join(F.broadcast(windows) if small else windows, ["fp", "digest", "n"]), "hits")
    places = hits.groupBy("_k", "_id").agg(F.collect_list(F.struct("starts", "n")).alias("places"))
    named = (hits.select("_k", "_id", "fp", "digest", "n").distinct().join(tests, ["fp", "digest", "n"])
             .groupBy("_k", "_id").agg(F.collect_set("item").alias("items")))
    heads = found.where("n_words is not null").select("_k", "_id", "n_words")
    out = join_keys(join_keys(heads, places, ["_k", "_id"]), named, ["_k", "_id"])
    return out.select(
        "_k", F.col("_id").alias(id_col), "n_words", "items",
        F.expr("flatten(transform(places, p -> transform(p.starts, s -> struct(s as start, p.n as n))))").alias("places"))


def hit_words() -> object:
    """Number of distinct words in ``places``."""
    return F.expr("cast(coalesce(size(array_distinct(flatten(transform(places, p -> sequence(p.start, p.start + p.n - 1))))), 0) as long)")


def q_op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    d = d.withColumn("n_hit", F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(hit_words()))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return d.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


def sql_op3() -> str:
    wl = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {wl} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {wl} AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ln WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT rid, n, i, g FROM dw WHERE (n, g) IN (SELECT n, g FROM bw)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h JOIN bw USING (n, g)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""
