"""Exact set-similarity join of documents' word shingles, with skipping by set relations.

A document's set is its distinct ``k``-word shingles (64-bit hashes).  Sets are put in one order of
shingles, rare ones first, and only the first n - ceil(0.8 n) + 1 of a set of n are listed: two sets
that reach the threshold share a listed shingle.  Rarity comes from a sketch of fixed size that counts
shingles over all documents; it only sets the order, which may be any.

* Equal sets are one set (copies are linked by grouping).
* First a set is only compared with the leaders of sets with an equal least shingle (in ``MINS`` orders):
  a few pairs for each set, which find large groups of near copies without making their pairs.  Sets found
  similar form components, and a set takes over the answers of its component: no pair within a
  component is compared again, and a list whose sets are all in one component has nothing to tell.
  In further rounds a few pairs of each two components that meet in a list are compared.
* Lists of one document are dropped.  Of lists of the same sets (a passage that stands in several documents
  makes one for each of its listed shingles) only the first in the order of shingles stays: their sets all meet
  there, with the most shingles behind it.
* A list is grouped by size class, so sets of too different size never
  meet.  In the last round all pairs of a list between different components are made, where the places of the
  shingle in both sets leave enough shingles behind it and the parities of both sets' shingles in
  ``ODD_BITS`` buckets (in the join's condition) allow it.  So no link between components is lost.  Two sets
  do not meet again in a list if one of the ``BEFORE`` lists before it is the same in both: they met there.
* Bit maps and counts of both sets bound their difference from below; a pair beyond the bound is not verified.

Pairs are verified on the whole sets.

Defined results: a null or empty text, or one without words, has the empty set and its own id as
component; fewer than ``k`` words are one shingle of all of them; repeated rows are linked; rows with a
null id take part, and the component is named by the smallest id in it (null if there is none);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.common import (LOWER, LOWER_AZ, NON_SPACE, U64, UPPER_AZ, KeyFilter, components, digest16, discard, doc_key,
                                  gram_hashes, join_keys, mix, read, row_of, slices, span_hashes, spaced, stored, words)

SKETCH = 24         # log2 of the counters: rarity
LOCAL, HOT = 4, 32  # a counter is told by a task from LOCAL on, and counts as frequent from HOT on in all
MAP_BITS = 1024     # bit map of a set
ODD_BITS = 512      # parities of a set's shingles in as many buckets: bounds the difference of two sets, for the join of lists
MINS = 6            # orders of which a set's least shingle is taken
TRIED = 4           # pairs of two components that a round compares
BEFORE = 4          # lists of a set looked back at, for whether two sets have met
COUNTED = 600       # a larger set fills its bit map, so it also has counts of its shingles in as many buckets (a byte each)


def _shingles(batch: pa.RecordBatch, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of a batch, repeats included."""
    buf, offs = spaced(batch.column(batch.schema.get_field_index(text)))
    buf = LOWER[buf]
    s, e = words(buf, NON_SPACE)
    h, row = span_hashes(buf, s, e), row_of(s, offs)
    g = gram_hashes(h, k)
    ok = row[: len(g)] == row[k - 1: k - 1 + len(g)]
    rows, gs = row[: len(g)][ok], g[ok]
    n = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        more = np.array([gram_hashes(h[first[r]: first[r + 1]], int(n[r]))[0] for r in short], U64)
        rows, gs = np.concatenate([rows, short]), np.concatenate([gs, more])
    return rows, gs


def _sets(batch: pa.RecordBatch, text: str, k: int, freq: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles in order of row, then rarity (if given), then hash; and n + 1 bounds."""
    rows, g = _shingles(batch, text, k)
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    rows, g = rows[new], g[new]
    if freq is not None and len(freq):
        f = freq[(g >> U64(64 - SKETCH)).astype(np.int64)]
        if f.any():
            order = np.lexsort((g, f, rows))
            g = g[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
    return rows, g, bounds


def _rarity(docs: DataFrame, k: int) -> np.ndarray:
    """Counters of frequent shingles (log2 of the count, 0 for others), of a fixed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, np.uint8)        # counts up to 255 in one task; more makes no difference
        held, size = [], 0

        def add():
            i, c = np.unique(np.concatenate(held), return_counts=True)
            total[i] = np.minimum(total[i] + np.minimum(c, 255), 255).astype(np.uint8)

        for b in slices(batches, "text", 1 << 20):
            _, g = _shingles(b, "text", k)
            held.append((g >> U64(64 - SKETCH)).astype(np.int32))
            size += len(g)
            if size > 1 << 20:
                add()
                held, size = [], 0
        if held:
            add()
        at = np.flatnonzero(total >= LOCAL)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int32))], names=["i", "c"])

    told = docs.select("text").mapInArrow(run, "i int, c int").groupBy("i").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT)
    got = told.select("i", F.floor(F.log2("c")).cast("int").alias("f")).toArrow()     # at most 2 ** SKETCH rows
    freq = np.zeros(1 << SKETCH, np.uint8)
    freq[got["i"].to_numpy()] = got["f"].to_numpy()
    return freq


def _tasks_array(spark: SparkSession, a: np.ndarray):
    """A broadcast of an array of fixed size (sent packed: mostly zeros)."""
    import zlib

    return spark.sparkContext.broadcast((zlib.compress(a.tobytes(), 1), a.dtype.str))


def _unpacked(sent) -> np.ndarray:
    import zlib

    data, kind = sent.value
    return np.frombuffer(zlib.decompress(data), kind)


def _listed(docs: DataFrame, k: int, freq: np.ndarray, share: tuple[int, int]) -> DataFrame:
    """k, id, n, digest of the set, its listed shingles, bit map and (if large) counts."""
    kind = docs.schema["id"].dataType.simpleString()
    sent = _tasks_array(docs.sparkSession, freq)
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpacked(sent)
        for b in slices(batches, "text", 1 << 20):
            rows, g, bounds = _sets(b, "text", k, table)
            n = np.diff(bounds)
            at = rows.astype(np.int64) * MAP_BITS + (g & U64(MAP_BITS - 1)).astype(np.int64)
            counts = np.minimum(np.bincount(at, minlength=b.num_rows * MAP_BITS), 255).astype(np.uint8).reshape(-1, MAP_BITS)
            maps = np.packbits(counts > 0, axis=1)
            wide = pa.array([c.tobytes() if m > COUNTED else None for c, m in zip(counts, n.tolist())], pa.binary())
            odd = np.bincount(rows.astype(np.int64) * ODD_BITS + (g >> U64(12) & U64(ODD_BITS - 1)).astype(np.int64), minlength=b.num_rows * ODD_BITS)
            odd = np.packbits((odd & 1).astype(np.uint8).reshape(-1, ODD_BITS), axis=1).view(np.int64)
            some = np.flatnonzero(n)
            mins = np.zeros((MINS, b.num_rows), U64)
            for i in range(MINS):
                mins[i, some] = np.minimum.reduceat(mix(g ^ mix(U64([i + 1]))), bounds[some]) if len(some) else 0
            data, heads, digests = memoryview(np.ascontiguousarray(g)).cast("B"), [], []
            for a, c in zip(bounds[:-1].tolist(), n.tolist()):
                p = c - -(-num * c // den) + 1 if c else 0
                heads.append(bytes(data[8 * a: 8 * (a + p)]))
                digests.append(digest16(data[8 * a: 8 * (a + c)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()), pa.array(heads, pa.binary()),
                 pa.array([m.tobytes() for m in maps], pa.binary()), wide,
                 pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(mins.T).reshape(-1).view(np.int64)), MINS).cast(pa.list_(pa.int64())),
                 *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(odd.shape[1])]],
                names=["k", "id", "n", "digest", "listed", "map", "wide", "mins", *[f"p{i}" for i in range(odd.shape[1])]])

    parities = ", ".join(f"p{i} long" for i in range(ODD_BITS // 64))
    return docs.select("k", "id", "text").mapInArrow(
        run, f"k long, id {kind}, n long, digest binary, listed binary, map binary, wide binary, mins array<long>, {parities}")


def _entries(sets: DataFrame) -> DataFrame:
    """(shingle, k, n, pos) of lists that hold several sets."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                heads = b.column(2).to_pylist()
                size = np.array([len(x) // 8 for x in heads], np.int64)
                tok = np.frombuffer(b"".join(heads), np.int64)
                row = np.repeat(np.arange(len(heads)), size)
                pos = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
                n = b.column(1).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(b.column(0).to_numpy()[row]), pa.array((n << 32) | pos)],
                                                 names=["shingle", "k", "np"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shingle: those whose shingle is that of a neighbour.  The last row of a
        batch waits for the next batch."""
        wait: pa.RecordBatch | None = None
        before: int | None = None                  # shingle of the row before the waiting one
        def out(t: pa.Table, prev: int | None, final: bool):
            s = t.column(0).to_numpy()
            same = np.zeros(len(s) + 1, bool)
            same[1:-1] = s[1:] == s[:-1]
            same[0] = prev is not None and prev == s[0]
            keep = same[:-1] | same[1:]
            return t.filter(pa.array(keep if final else keep[:-1])) if final else t.slice(0, len(s) - 1).filter(pa.array(keep[:-1]))
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([x for x in (wait, b) if x is not None])
            if t.num_rows > 1:
                yield from out(t, before, False).to_batches()
                before = t.column(0)[t.num_rows - 2].as_py()
            wait = t.slice(t.num_rows - 1).combine_chunks().to_batches()[0]
        if wait is not None:
            yield from out(pa.Table.from_batches([wait]), before, True).to_batches()

    schema = "shingle long, k long, np long"
    rows = sets.select("k", "n", "listed").mapInArrow(explode, schema)
    rows = rows.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(several, schema)
    return rows.select("shingle", "k", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND((1 << 32) - 1).alias("pos"))


def _first_of_equal(lists: DataFrame) -> DataFrame:
    """Of lists with the same sets (told by 128 bits and their number) the first in the order of shingles, which
    all sets share: there each of the sets has its least place, so the sum of places is least."""
    told = lists.groupBy("shingle").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y"),
                                        F.sum("pos").alias("places"))
    first = told.groupBy("c", "x", "y").agg(F.min(F.struct("places", "shingle")).alias("o")).select("o.shingle")
    return lists.join(first, "shingle", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Those of the distinct pairs (a, b) that reach the threshold."""
    num, den = share
    maps = sets.select("k", "n", "map", "wide")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            # inter >= num/den * union  <=>  difference * (num + den) <= total * (den - num)
            ok = apart * (num + den) <= total * (den - num)
            # counts differ by no more than the sets do, and do not fill up as bits do
            both = np.flatnonzero(ok & b.column(6).is_valid().to_numpy(False) & b.column(7).is_valid().to_numpy(False))
            if len(both):
                x, y = (np.frombuffer(b"".join(b.column(i).take(pa.array(both)).to_pylist()), np.uint8).reshape(len(both), -1) for i in (6, 7))
                apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
                ok[both] = apart * (num + den) <= total[both] * (den - num)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    side = lambda c: maps.select(F.col("k").alias(c), F.col("n").alias("n" + c), F.col("map").alias("m" + c), F.col("wide").alias("w" + c))
    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb", "wa", "wb").mapInArrow(near, "a long, b long")
    close = stored(close, "close")

    # the whole sets of the documents in question, picked where they are read
    asked = stored(close.select(F.col("a").alias("k")).union(close.select("b")).distinct(), "asked")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in slices(batches, "text", 1 << 20):
            _, g, bounds = _sets(c, "text", k, None)
            data = memoryview(np.ascontiguousarray(g)).cast("B")
            yield pa.RecordBatch.from_arrays(
                [c.column(0), pa.array([bytes(data[8 * x: 8 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())],
                names=["k", "s"])

    full = KeyFilter(asked).split(docs.select("k", "text"), True, "k", whole, "k long, s binary")
    full = stored(full.join(asked, "k", "left_semi").dropDuplicates(["k"]), "sets")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                inter = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(den * inter >= num * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = (close.join(full.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
            .join(full.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb"))
    done = stored(both.mapInArrow(reach, "a long, b long"), "verified")
    discard(close, asked, full)
    return done


def _leaders(reps: DataFrame) -> DataFrame:
    """Pairs of sets that share the least shingle of one of ``MINS`` orders, one set of each (order,
    shingle, size class) being the partner of all others and of those of the next class: at most 2 ``MINS`` pairs
    for each set, however many are alike."""
    rows = reps.select("k", "n", "size", F.posexplode("mins").alias("r", "m"))
    first = rows.groupBy("r", "m", "size").agg(F.min(F.struct(F.xxhash64("k").alias("h"), "k", "n")).alias("o"))
    first = first.select("r", "m", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), F.col("o.k").alias("b"), F.col("o.n").alias("nb"))
    met = rows.select("r", "m", "size", F.col("k").alias("a"), F.col("n").alias("na")).join(first, ["r", "m", "size"])
    return met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb")


def _met(rest: DataFrame, may: Column) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in a list of ``rest`` and that ``may`` allows."""
    side = lambda c: [F.col("k").alias(c), F.col("n").alias("n" + c), F.col("pos").alias("p" + c), F.col("component").alias("c" + c),
                      F.col("before").alias("before" + c), *[F.col(f"p{i}").alias(f"{c}p{i}") for i in range(ODD_BITS // 64)]]
    a = rest.select("shingle", F.col("size").alias("to"), *side("a"))
    b = rest.select("shingle", *side("b"), F.col("size").alias("sb"), F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("to"))
    once = (F.col("to") < F.col("sb")) | (F.col("a") < F.col("b"))
    new = ~F.arrays_overlap("beforea", "beforeb")
    met = a.join(b, ["shingle", "to"]).where((F.col("ca") != F.col("cb")) & once & may & new)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar(docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5), rounds: int = 2, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row for each document: _k (doc_key), id, n_shingles, component_id, the smallest id
    reachable by links of Jaccard similarity >= share[0] / share[1], and component, a doc_key that names
    the component itself (two components may have the same smallest id)."""
    num, den = share
    named = docs.select(doc_key(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = stored(_listed(named, k, _rarity(named, k), share), "sets")
    filled = sets.where("n > 0")
    kinds = filled.groupBy("digest").agg(F.min("k").alias("rep"))
    copies = filled.select("k", "digest").join(kinds, "digest").where("k <> rep").select(F.col("k").alias("a"), F.col("rep").alias("b")).distinct()
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-9).cast("int").alias("size")
    reps = filled.join(kinds.select(F.col("rep").alias("k")), "k", "left_semi").dropDuplicates(["k"])
    entries = stored(_entries(reps).withColumn("size", size), "entries")
    lists = stored(_first_of_equal(entries), "lists")
    discard(entries)
    reps = filled.dropDuplicates(["k"])
    one_each = kinds.select(F.col("rep").alias("k"))

    fits = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - 1e-9)
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need
    odd = [f"p{i}" for i in range(ODD_BITS // 64)]
    apart = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in odd), F.lit(0))
    close = apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)

    def check(pairs: DataFrame) -> DataFrame:
        return _verified(pairs.select("a", "b").distinct(), reps, named, k, share)

    def mixed(links: DataFrame) -> DataFrame:
        """The lists with sets of several components."""
        of = components(links).select(F.col("node").alias("k"), "component")
        rest = lists.join(of, "k", "left").select(
            "shingle", "k", "n", "pos", "size", F.coalesce("component", "k").alias("component"))
        some = rest.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle")
        return rest.join(some, "shingle")

    links = None
    for r in range(rounds):
        if r == 0:      # the leaders of equal least shingles
            pairs = _leaders(reps.join(one_each, "k", "left_semi").select("k", "n", size, "mins")).where(fits)
            links = check(pairs)
            continue
        # of each list, a set of each component and size class asks one set of each size class, of the component
        # that has most sets there; of the pairs of two components few are taken
        rest = stored(mixed(links), f"rest{r}")
        own = rest.groupBy("shingle", "component", "size").agg(
            F.count("*").alias("c"), F.min(F.struct(F.xxhash64("k", F.lit(r)).alias("h"), "k", "n")).alias("o")).select("shingle", "component", "size", "c", "o.*")
        one = own.groupBy("shingle", "size").agg(F.min(F.struct((-F.col("c")).alias("c"), F.xxhash64("component", F.lit(r)).alias("h"), F.col("k").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))).alias("o"))
        one = one.select("shingle", "o.b", "o.nb", "o.cb", F.explode(F.array(F.col("size"), F.col("size") - 1, F.col("size") + 1)).alias("size"))
        a = own.select("shingle", "size", F.col("k").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
        met = a.join(one, ["shingle", "size"]).where((F.col("ca") != F.col("cb")) & fits)
        met = met.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(
            *[F.min(F.struct(F.xxhash64("a", "b", F.lit(i)).alias("h"), "a", "b")).alias(f"o{i}") for i in range(TRIED)])
        met = met.select(F.explode(F.array(*[f"o{i}" for i in range(TRIED)])).alias("o"))
        links = links.union(check(met.select(F.least("o.a", "o.b").alias("a"), F.greatest("o.a", "o.b").alias("b"))))
        discard(rest)
    # every pair of a list between components that place and parities leave
    rest = mixed(links) if rounds else lists.withColumn("component", F.col("k"))
    before = F.collect_list("shingle").over(Window.partitionBy("k").orderBy("pos").rowsBetween(-BEFORE, -1))
    rest = stored(rest.withColumn("before", before).join(reps.select("k", *odd), "k"), "rest")
    found = check(_met(rest, fits & left & close))
    links = found if links is None else links.union(found)
    discard(rest)
    comp = components(links.union(copies))
    of = comp.select(F.col("node").alias("k"), "component")
    every = sets.select("k", "id", "n").join(of, "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = every.where("n > 0").groupBy("component").agg(F.min("id").alias("smallest"))
    out = join_keys(every, least, ["component"])
    return out.select(F.col("k").alias("_k"), "id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component_id"), "component")


def q_op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def sql_op4() -> str:
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)"""
