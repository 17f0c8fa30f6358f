"""Removal of repeated byte strings by suffix arrays.

Every string of ``size`` bytes that stands in two places, in one document or two, is removed in both.

1. Winnowing names each window of ``size`` bytes by the smallest hash among its ``GRAM``-byte strings, so equal
   windows have equal names.  Consecutive windows named by one place form a stretch.  Names that
   occur once are dropped.
2. A stretch whose whole bytes (128-bit digest) occur twice under a name repeats as a whole: a
   pre-aggregation of copies, after which one stretch of each kind is left.
3. Stretches that share a name but differ go to shards by name, a bounded number of bytes to each.  A
   shard is one text: its suffix array (Larsson-Sadakane) and common prefixes (Kasai) give the windows that
   stand in two places.  A name with more bytes than a shard is cut over several; each of them then
   hands on its windows as 128-bit digests, and equal digests are grouped over all shards.  So 2 and the
   windows of cut names are decided by digests, without a suffix order between shards.

A text moves once.  Defined results: null or empty texts have no bytes; texts shorter than ``size`` are kept
whole; repeated rows are documents of their own, so long ones are removed in full; null ids are carried
through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm.common import U64, KeyFilter, _BYTE, digest16, discard, doc_key, groups_of, mix, powers, read, slices, stored, text_buffer, with_some
from pressroom.llm.suffixarray import common_prefixes, suffix_array

GRAM = 40
SEGMENT = 4 << 20           # bytes of a text that are named at once
SHARD_BYTES = 2 << 20       # bytes of stretches in one shard
_POS = U64((1 << 24) - 1)


def smallest(v: np.ndarray, m: int) -> np.ndarray:
    """The minimum of each m consecutive values, by block-wise running minima from both sides."""
    n = len(v) - m + 1
    pad = -len(v) % m
    w = np.concatenate([v, np.full(pad, ~U64(0))]).reshape(-1, m)
    left = np.minimum.accumulate(w, axis=1).reshape(-1)
    right = np.minimum.accumulate(w[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[m - 1: m - 1 + n])


def names(buf: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` bytes the place of its naming gram, and that gram's hash."""
    a, inv = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        p = np.empty(len(buf) + 1, U64)
        p[0] = 0
        np.cumsum(_BYTE[buf] * a[: len(buf)], dtype=U64, out=p[1:])
        n = len(buf) - gram + 1
        h = mix((p[gram:] - p[:-gram]) * inv[:n])
    best = smallest((h & ~_POS) | np.arange(n, dtype=U64), size - gram + 1)
    at = (best & _POS).astype(np.int64)
    return at, h


def _stretches(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(name, digest, k, lo, hi): windows lo..hi of a text are named by one place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            keys = b.column(0).to_numpy()
            buf, offs = text_buffer(b.column(1))
            view = memoryview(buf)
            out: list[list] = [[], [], [], [], []]
            # texts of a batch share one pass; windows over two texts are left out
            pieces = [(0, len(buf))] if len(buf) <= SEGMENT else [
                (i, min(i + SEGMENT + size - 1, len(buf))) for i in range(0, len(buf), SEGMENT)]
            for lo, hi in pieces:
                if hi - lo < size:
                    continue
                at, h = names(buf[lo:hi], size, gram)
                start = np.arange(len(at)) + lo
                doc = np.searchsorted(offs, start, "right") - 1
                ok = start + size <= offs[doc + 1]
                new = ok.copy()
                new[1:] &= (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                ends = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
                d = doc[first]
                out[0].append(h[at[first]].view(np.int64))
                out[1] += [digest16(view[x: y + size]) for x, y in zip((first + lo).tolist(), (ends + lo).tolist())]
                out[2].append(keys[d])
                out[3].append((first + lo - offs[d]).astype(np.int64))
                out[4].append((ends + lo - offs[d]).astype(np.int64))
            if out[1]:
                c = [np.concatenate(out[i]) for i in (0, 2, 3, 4)]
                dig = out[1]
                for i in range(0, len(dig), 50_000):
                    q = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(c[0][q]), pa.array(dig[q], pa.binary()), pa.array(c[1][q]),
                                                      pa.array(c[2][q]), pa.array(c[3][q])], names=["name", "digest", "k", "lo", "hi"])

    rows = docs.where("text is not null").select("_k", "text")
    return rows.mapInArrow(run, "name long, digest binary, k long, lo long, hi long")


def _runs(starts: np.ndarray) -> list[dict]:
    """Increasing window starts as [a, b) runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    a, b = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + 1
    return [{"a": int(x), "b": int(y)} for x, y in zip(a, b)]


def _in_shards(contexts: DataFrame, size: int) -> DataFrame:
    """Stretches of one shard meet as one text.  Gives (k, hits) for windows that repeat within the
    shard, and (k, at, window digest) for the others if their name is cut over shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tab in groups_of(batches, 2):
            # a repeated row hands its stretches on once more: each place counts once
            seen = dict.fromkeys(zip(tab.column("k").to_pylist(), tab.column("lo").to_pylist()))
            if len(seen) < tab.num_rows:
                once = {x: i for i, x in enumerate(zip(tab.column("k").to_pylist(), tab.column("lo").to_pylist()))}
                tab = tab.take(pa.array(sorted(once.values())))
            data = tab.column("bytes").to_pylist()
            text = np.frombuffer(b"\xff".join([*data, b""]), np.uint8)         # 0xff is in no UTF-8 text
            begin = np.cumsum([0] + [len(x) + 1 for x in data[:-1]])
            sa = suffix_array(text)
            lcp = common_prefixes(text, sa, size)
            again = lcp >= size
            again[:-1] |= lcp[1:] >= size
            twice = np.zeros(len(text), bool)
            twice[sa[again]] = True
            ks, los, split = tab.column("k").to_pylist(), tab.column("lo").to_pylist(), tab.column("split").to_pylist()
            lone = tab.column("lone").to_pylist()
            rows: list[tuple] = []
            whole = text.tobytes()
            for x, at, k, lo, cut, one in zip(data, begin.tolist(), ks, los, split, lone):
                n = len(x) - size + 1
                t = twice[at: at + n]
                hits = np.flatnonzero(t)
                if one and len(hits):
                    rows.append((k, _runs(hits + lo), None, None, None))
                if cut:
                    rows += [(k if one else None, None, lo + i, digest16(whole[at + i: at + i + size]), bool(t[i]))
                             for i in range(n)]
            for i in range(0, len(rows), 20_000):
                c = list(zip(*rows[i: i + 20_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                     pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.bool_())],
                    names=["k", "hits", "at", "digest", "settled"])

    laid = contexts.repartition("shard", "part").sortWithinPartitions("shard", "part")
    return laid.mapInArrow(run, "k long, hits array<struct<a:long,b:long>>, at long, digest binary, settled boolean")


def _across(cut: DataFrame) -> DataFrame:
    """(k, hits) for windows of cut names that also stand in another shard: equal digests meet in one
    task by their hash, are sorted there and counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs = list(batches)
        if not tabs:
            return
        t = pa.Table.from_batches(tabs)
        raw = np.frombuffer(b"".join(t.column("digest").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        s = raw[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        at = np.searchsorted(first, np.arange(len(s)), "right") - 1
        count = np.diff(np.append(first, len(s)))[at]
        hit = order[count > 1]
        ks, ats = t.column("k").to_pylist(), t.column("at").to_pylist()
        rows = [(ks[i], [{"a": ats[i], "b": ats[i] + 1}]) for i in hit.tolist() if ks[i] is not None]
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                                             names=["k", "hits"])

    return cut.select("k", "at", "digest").repartition("digest").mapInArrow(run, "k long, hits array<struct<a:long,b:long>>")


def _removed(n: int, size: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed [a, b) of n bytes, from runs [a, b) of window starts."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        b += size - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _result(key, ident, data: memoryview, size: int, runs, texts: bool) -> tuple:
    gone = _removed(len(data), size, runs)
    h = hashlib.sha256()
    parts, at = [], 0
    for a, b in [*gone, (len(data), len(data))]:
        h.update(data[at:a])
        if texts:
            parts.append(bytes(data[at:a]))
        at = b
    return (key, ident, len(data), sum(b - a for a, b in gone), len(gone), h.hexdigest(), b"".join(parts) if texts else None)


_TYPES = [pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def dedup_bytes(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row for each document: _k, id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    the kept bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(doc_key(id_col, text_col).alias("_k"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stored(_stretches(rows, size, min(GRAM, size)), "stretches")
    shared = found.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name")
    shared = stored(shared, "names")
    every, found = found, stored(KeyFilter(shared, "name").split(found, True, "name").join(shared, "name"), "shared")
    discard(every, shared)
    kinds = stored(found.groupBy("name", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("k", "lo", "hi")).alias("at")), "kinds")
    # names with several kinds of stretches: all of these go to the shards, unless no kind is single
    held = kinds.groupBy("name").agg(F.count("*").alias("c"), F.count_if(F.col("copies") == 1).alias("single"),
                                     F.sum(F.col("at.hi") - F.col("at.lo") + size + 1).alias("bytes"))
    held = held.where("c > 1 and single > 0").select("name", "bytes")
    total = held.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    held = held.select("name", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("long").alias("shard"),
                       F.ceil(F.col("bytes") / SHARD_BYTES).cast("long").alias("parts"))
    asked = kinds.join(held, "name").select(
        F.col("at.k").alias("k"), F.struct(
            F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "shard",
            F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("digest", "name"), F.col("parts")) + F.col("parts") * F.pmod(F.xxhash64("name", F.lit(1)), F.lit(1 << 20)))
            .otherwise(0).alias("part"), (F.col("parts") > 1).alias("split"), (F.col("copies") == 1).alias("lone")).alias("ask"))
    whole = found.join(kinds.where("copies > 1").select("name", "digest"), ["name", "digest"]).select("k", F.struct(F.col("lo").alias("a"), (F.col("hi") + 1).alias("b")).alias("run"))
    per_doc = (whole.select("k", "run", F.lit(None).cast(asked.schema["ask"].dataType).alias("ask"))
               .union(asked.select("k", F.lit(None).cast(whole.schema["run"].dataType).alias("run"), "ask"))
               .groupBy("k").agg(F.collect_set("run").alias("runs"), F.collect_set("ask").alias("asks")))

    final = f"_k long, id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            keys, ids = b.column(0).to_pylist(), b.column(1)
            buf, offs = text_buffer(b.column(2))
            view = memoryview(np.ascontiguousarray(buf))
            rows = []
            for r, (key, ident, runs, asks) in enumerate(zip(keys, ids.to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                data = view[int(offs[r]): int(offs[r + 1])]
                runs = [(x["a"], x["b"]) for x in runs or ()]
                open_ = any(x["lone"] for x in asks or ())
                ctx = [{**x, "bytes": bytes(data[x["lo"]: x["hi"] + size])} for x in asks or ()]
                if open_:
                    rows.append((key, ident, None, None, None, None, None, bytes(data), [{"a": x, "b": y} for x, y in runs], ctx))
                else:
                    rows.append((*_result(key, ident, data, size, runs, texts), None, None, ctx))
            if rows:
                c = list(zip(*rows))
                types = [*_TYPES, pa.binary(), run_pa, ctx_pa]
                types[1] = ids.type
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)],
                                                 names=["_k", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "data", "runs", "contexts"])

    run_pa = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    ctx_pa = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()),
                                 ("split", pa.bool_()), ("lone", pa.bool_()), ("bytes", pa.binary())]))
    most = stored(with_some(rows, per_doc, settle, final + ", data binary, runs array<struct<a:long,b:long>>, contexts "
                            "array<struct<lo:long,hi:long,shard:long,part:long,split:boolean,lone:boolean,bytes:binary>>"), "settled")
    discard(found, kinds)
    contexts = most.select("_k", F.explode("contexts").alias("c")).select(
        "c.shard", "c.part", F.col("_k").alias("k"), "c.lo", "c.split", "c.lone", "c.bytes")
    hits = stored(_in_shards(contexts, size), "hits")
    cut = hits.where("digest is not null")
    ends = hits.where("hits is not null").select("k", "hits").union(_across(cut))
    ends = ends.groupBy("k").agg(F.flatten(F.collect_list("hits")).alias("hits"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, ident, data, runs, more in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(_result(key, ident, memoryview(data), size, [(x["a"], x["b"]) for x in [*runs, *(more or ())]], texts))
            if rows:
                types = [*_TYPES]
                types[1] = b.column(1).type
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                                                 names=["_k", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cols = ["_k", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    rest = most.where("data is not null").select("_k", "id", "data", "runs")
    rest = with_some(rest, stored(ends, "ends"), finish, final)
    return most.where("data is null").select(*cols).union(rest.select(*cols))


def q_op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(read(spark, sf_dir, "documents"), texts=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def sql_op6() -> str:
    return """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS MATERIALIZED (SELECT rid, i, md5_number(h[2 * i + 1:2 * i + 400]) AS g
  FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
c AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
w AS (SELECT rid, i FROM g SEMI JOIN c USING (g)),
s AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY rid ORDER BY i) IS NULL THEN 1 ELSE 0 END AS b FROM w),
r AS (SELECT rid, i, sum(b) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
z AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS e FROM r GROUP BY rid, run),
k AS (SELECT rid, a, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS from_ FROM z),
q AS (SELECT rid, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last,
        string_agg(h[2 * from_ + 1:2 * a], '' ORDER BY a) AS front FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256
FROM d LEFT JOIN q USING (rid)"""
