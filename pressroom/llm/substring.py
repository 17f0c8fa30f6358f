"""Substring dedup: words covered by long spans that start in an earlier document are removed.

A window is ``size`` consecutive words.  Recompression (see recompress.py) gives each window an
anchor, a symbol that every equal window has at the same place, so equal windows meet under one
symbol.  Consecutive windows with one anchor occurrence form a stretch of some tens of words:

1. Symbols that occur in one document only are dropped; nothing else can repeat.
2. A stretch whose whole words (128-bit digest) also stand in an earlier document under the same
   symbol is removed at once.  That settles the inside of long repeats.
3. What is left under a symbol with several different stretches, the ends of repeats, is compared
   window by window (128-bit digests), in the earliest document of each different stretch only.

All groupings are aggregates with map-side parts or joins against a side with one row for each key,
so that a passage held by a third of all documents is pre-aggregated or split.  A text moves once.

Defined results: a null or empty text has no words and keeps the empty text; a document with fewer
than ``size`` words is kept whole; rows with a null id have no order, so they neither lose words nor take
words from others; repeated rows (equal id) are not earlier than each other and get equal results;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm.common import (NON_SPACE, U64, KeyFilter, digest16, discard, doc_key, mix, read, row_of, slices, span_hashes, spaced,
                                  stored, with_some, words)
from pressroom.llm.recompress import anchors


class Words:
    """The words of a batch of texts, each followed by one space, in one buffer."""

    def __init__(self, col: pa.Array):
        buf, offs = spaced(col)
        s, e = words(buf, NON_SPACE)
        keep = NON_SPACE[buf]
        keep[e] = True                       # the separator after each word
        self.buf = buf[keep]
        self.buf[np.cumsum(e - s + 1) - 1] = 0x20
        self.row = row_of(s, offs)
        self.n = np.bincount(self.row, minlength=len(offs) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.n)])       # number of a row's first word
        self.end = np.cumsum(e - s + 1)                             # after the word's space
        self.start = np.concatenate([[0], self.end])[:-1]
        self.view = memoryview(np.ascontiguousarray(self.buf))

    def digest(self, lo: int, hi: int) -> bytes:
        return digest16(self.view[self.start[lo]: self.end[hi - 1] - 1])

    def text(self, kept: np.ndarray, row: int) -> bytes:
        """The kept words of a row joined by one space; ``kept`` is over all words."""
        a, b = self.first[row], self.first[row + 1]
        if a == b:
            return b""
        k = kept[a:b]
        if k.all():
            return bytes(self.view[self.start[a]: self.end[b - 1] - 1])
        mask = np.repeat(k, self.end[a:b] - self.start[a:b])
        return self.buf[self.start[a]: self.end[b - 1]][mask].tobytes()[:-1]


def _stretches(docs: DataFrame, size: int) -> DataFrame:
    """(name, digest, id, k, lo, hi): windows lo..hi of a document share the anchor ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            keys, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            w = Words(b.column(2))
            n, total = len(keys), len(w.row)
            h = span_hashes(w.buf, w.start, w.end - 1)
            place = np.arange(total) + w.row + 1                     # a separator before each row, one at the end
            names = np.zeros(total + n + 1, U64)
            sep = np.ones(total + n + 1, bool)
            names[place], sep[place] = h, False
            begin = w.first[:-1] + np.arange(n) + 1
            long = np.flatnonzero(w.n >= size)
            if not len(long):
                continue
            windows = w.n[long] - size + 1
            doc = np.repeat(long, windows)
            lo = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            rnd, name, at = anchors(names, sep, begin[doc] + lo, size)
            new = np.ones(len(doc), bool)
            new[1:] = (at[1:] != at[:-1]) | (rnd[1:] != rnd[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            d = doc[first]
            tag = mix(name[first] + rnd[first].astype(U64)).view(np.int64)
            f, t = w.first[d] + lo[first], w.first[d] + lo[last] + size
            for i in range(0, len(first), 50_000):
                q = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tag[q]), pa.array([w.digest(x, y) for x, y in zip(f[q].tolist(), t[q].tolist())], pa.binary()),
                     pa.array(ids[d[q]]), pa.array(keys[d[q]]), pa.array(lo[first[q]].astype(np.int32)),
                     pa.array(lo[last[q]].astype(np.int32))], names=["name", "digest", "id", "k", "lo", "hi"])

    return docs.where("id is not null and text is not null").mapInArrow(run, "name long, digest binary, id long, k long, lo int, hi int")


def _cover(n: int, spans) -> np.ndarray:
    """Which of n words are not inside the [start, stop) spans."""
    change = np.zeros(n + 1, np.int64)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) == 0


def dedup(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: _k (doc_key), id, n_words, n_removed, kept_sha256 and, if asked for,
    the kept text (the text itself if nothing was removed, else the kept words joined by one
    space).  The columns ``carry`` come along as the struct ``carried``."""
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(doc_key(id_col, text_col).alias("_k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       carried.alias("carried"))
    kind = rows.schema["carried"].dataType.simpleString()
    found = stored(_stretches(rows, size), "stretches")
    shared = found.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("name")
    shared = stored(shared, "names")
    every, found = found, stored(KeyFilter(shared, "name").split(found, True, "name").join(shared, "name"), "shared")
    discard(every, shared)
    first = found.groupBy("name", "digest").agg(F.min("id").alias("first"))
    several = first.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name", F.lit(True).alias("open"))
    told = found.join(first, ["name", "digest"]).join(several, "name", "left")
    told = told.where("first < id or open")
    spans = told.groupBy("k").agg(F.collect_list(F.struct("lo", "hi", (F.col("first") == F.col("id")).alias("open"))).alias("spans"))
    schema = ("_k long, id long, n_words long, n_removed long, kept_sha256 string, kept string, "
              f"carried {kind}, text string, "
              "done array<struct<a:int,b:int>>, windows array<struct<lo:int,digest:binary>>")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            w = Words(b.column(2))
            at = b.column(4).to_pylist()
            kept = np.ones(len(w.row), bool)
            cols: dict[str, list] = {x: [] for x in ("text", "done")}
            los, digests, bounds = [], [], [0]          # of the open windows, flat
            for r, sp in enumerate(at):
                a, z = int(w.first[r]), int(w.first[r + 1])
                done = [(s["lo"], s["hi"] + size) for s in sp or () if not s["open"]]
                kept[a:z] = _cover(z - a, done)
                opened = sorted({i for s in sp or () if s["open"] for i in range(s["lo"], s["hi"] + 1)})
                los += opened
                digests += [w.digest(a + i, a + i + size) for i in opened]
                bounds.append(len(los))
                cols["text"].append(b.column(2)[r].as_py() if opened else None)
                cols["done"].append([{"a": x, "b": y} for x, y in done] if opened else [])
            flat = pa.StructArray.from_arrays([pa.array(los, pa.int32()), pa.array(digests, pa.binary())], names=["lo", "digest"])
            more = {"text": pa.array(cols["text"], pa.string()),
                    "done": pa.array(cols["done"], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    "windows": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)}
            yield _result(b, w, kept, texts, [x == y for x, y in zip(bounds[:-1], bounds[1:])], more)

    most = stored(with_some(rows, spans, settle, schema), "settled")
    discard(found)

    # the ends of repeats, window by window
    ends = most.where("text is not null").select("_k", "id", F.explode("windows").alias("w")).select("_k", "id", "w.lo", "w.digest")
    early = ends.groupBy("digest").agg(F.min("id").alias("first"))
    hits = ends.join(early, "digest").where("first < id").groupBy("_k").agg(F.collect_set("lo").alias("hits"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            w = Words(b.column(2))
            kept = np.ones(len(w.row), bool)
            for r, (done, hit) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                a, z = int(w.first[r]), int(w.first[r + 1])
                kept[a:z] = _cover(z - a, [(d["a"], d["b"]) for d in done] + [(i, i + size) for i in hit or ()])
            yield _result(b, w, kept, texts, [True] * b.num_rows)

    cols = ["_k", "id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else []), *(["carried"] if carry else [])]
    rest = most.where("text is not null").select("_k", "id", "text", "carried", "done")
    rest = with_some(rest, stored(hits.withColumnRenamed("_k", "k"), "ends"), finish,
                     f"_k long, id long, n_words long, n_removed long, kept_sha256 string, kept string, carried {kind}")
    return most.where("text is null").select(*cols).union(rest.select(*cols))


def _text(b: pa.RecordBatch, row: int, kept: bytes, whole: bool) -> str | None:
    return b.column(2)[row].as_py() if whole else kept.decode()


def _result(b: pa.RecordBatch, w: Words, kept: np.ndarray, texts: bool, ready: list[bool], more: dict | None = None) -> pa.RecordBatch:
    left = np.add.reduceat(np.append(kept, False).astype(np.int64), np.minimum(w.first[:-1], len(kept))) if b.num_rows else np.zeros(0, np.int64)
    left[w.n == 0] = 0
    out = [w.text(kept, r) if ok else None for r, ok in enumerate(ready)]
    cols = [b.column(0), b.column(1), pa.array(w.n.astype(np.int64)), pa.array((w.n - left).astype(np.int64)),
            pa.array([None if t is None else hashlib.sha256(t).hexdigest() for t in out], pa.string()),
            pa.array([_text(b, r, t, left[r] == w.n[r]) if texts and t is not None else None for r, t in enumerate(out)], pa.string()),
            b.column(3)]
    names = ["_k", "id", "n_words", "n_removed", "kept_sha256", "kept", "carried"]
    for k, v in (more or {}).items():
        cols.append(v)
        names.append(k)
    return pa.RecordBatch.from_arrays(cols, names=names)


def q_op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"), texts=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def sql_op1() -> str:
    return r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
x AS (SELECT rid, list(i) AS hits FROM g JOIN m USING (g) WHERE first < doc_id GROUP BY rid),
gone AS MATERIALIZED (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM (SELECT rid, unnest(hits) AS i FROM x)),
p AS (SELECT rid, doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""
