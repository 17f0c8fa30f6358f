"""Near-duplicate vectors by cross-polytope hashing.

A vector is normalised, padded to a power of two and turned by three rounds of (random signs, fast
Hadamard transform); its hash is the axis it lies nearest to, with the sign.  ``HASHES`` hashes make
a bucket of one table.  In each table a vector lies in its home bucket and is also sent to ``PROBES``
buckets in which one hash is replaced by its second nearest axis.  Pairs that meet are verified by
cosine in double precision.

Equal vectors are one representative with a count.  A large bucket is cut into blocks and its pairs
of blocks go to different tasks, so no bucket is capped and no task holds more than two blocks.  No pairs
leave a task: for each representative it gives the number of vectors linked here and nowhere
before (every row carries its buckets of all tables, so a pair knows its first meeting), and a
spanning forest of the links, from which components are made by joins.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null id, link with nothing (component: own id); vectors of different lengths do not link; rows
that repeat an id and vector are vectors of their own and link with each other; ids name nodes, so one
id on two vectors joins their components; extra columns, the label among them, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm.common import components, read, stored

TABLES, HASHES, PROBES, BLOCK = 12, 2, 3, 2048


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and the fast Hadamard transform over the last axis."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def axes(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """(vectors, TABLES, 5): nearest and second nearest axis of both hashes, and which hash is the
    nearer to its second (0 or 1)."""
    n, dim = x.shape
    d = padded(dim)
    g = np.random.default_rng(seed)
    x = np.concatenate([x, np.zeros((n, d - dim))], axis=1)
    out = np.empty((n, TABLES, 5), np.uint8 if 2 * d <= 256 else np.uint32)
    rows = np.arange(n)
    for t in range(TABLES):
        loss = []
        for k in range(HASHES):
            y = rotate(x, g.choice([-1.0, 1.0], (3, d)))
            a = np.abs(y)
            top = np.argpartition(-a, 1, axis=1)[:, :2]
            swap = a[rows, top[:, 0]] < a[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            out[:, t, 2 * k: 2 * k + 2] = 2 * top + (y[rows[:, None], top] < 0)
            loss.append(a[rows, top[:, 0]] - a[rows, top[:, 1]])
        out[:, t, 4] = loss[0] > loss[1]
    return out


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def buckets(ax: np.ndarray, dim: int) -> np.ndarray:
    """(vectors, TABLES, 1 + PROBES) bucket numbers; the first is the home bucket."""
    wide = 2 * padded(dim)
    p, p2, q, q2, turn = (ax[:, :, i].astype(np.int64) for i in range(5))
    one, two = p2 * wide + q, p * wide + q2
    return np.stack([p * wide + q, np.where(turn == 0, one, two), np.where(turn == 0, two, one), p2 * wide + q2], axis=2)


def _units(vectors: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in doubles, of vectors of one length."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(reps: DataFrame, kind: type) -> DataFrame:
    """rep, n, dim, vec (the bytes of the components), axes (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(v) for v in b.column(2).to_pylist()], np.int64)
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                vec = [np.array(v, kind).tobytes() for v in b.column(2).take(at).to_pylist()]
                ax = axes(_units(vec, kind))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array([int(d)] * len(at), pa.int32()), pa.array(vec, pa.binary()),
                     pa.array([a.tobytes() for a in ax], pa.binary())], names=["rep", "n", "dim", "vec", "axes"])

    return reps.mapInArrow(run, "rep long, n long, dim int, vec binary, axes binary")


def _decoded(ax: list[bytes], dim: int) -> np.ndarray:
    kind = np.uint8 if 2 * padded(dim) <= 256 else np.uint32
    return buckets(np.frombuffer(b"".join(ax), kind).reshape(len(ax), TABLES, 5), dim)


def _places(hashed: DataFrame, full: bool) -> DataFrame:
    """A row for each bucket a vector lies in or is sent to; with the vector if ``full``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = TABLES * (1 + PROBES)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                dims = b.column(2).to_numpy()
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    codes = _decoded(b.column(4).take(pa.array(at)).to_pylist(), int(d))
                    row = pa.array(np.repeat(at, each))
                    cols = [pa.array(np.tile(np.repeat(np.arange(TABLES), 1 + PROBES), len(at)).astype(np.int32)),
                            pa.array(codes.reshape(-1)), pa.array(np.tile(np.arange(1 + PROBES), len(at) * TABLES) == 0),
                            b.column(2).take(row)]
                    if full:
                        cols += [b.column(j).take(row) for j in (0, 1, 3, 4)]
                    yield pa.RecordBatch.from_arrays(cols, names=["t", "bucket", "home", "dim", *(["rep", "n", "vec", "axes"] if full else [])])

    return hashed.mapInArrow(run, "t int, bucket long, home boolean, dim int" + (", rep long, n long, vec binary, axes binary" if full else ""))


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of code arrays (pairs, TABLES, 1 + PROBES): (pairs, TABLES) whether they meet, as
    1 in the home bucket of both, 2 in the home of b, 3 in the home of a only."""
    same = a[:, :, 0] == b[:, :, 0]
    at_b = (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
    at_a = (b[:, :, 1:] == a[:, :, :1]).any(axis=2)
    return np.select([same, at_b, at_a], [1, 2, 3], 0)


def _links(t: int, home: np.ndarray, block: np.ndarray, pair: tuple[int, int], rep: np.ndarray,
           unit: np.ndarray, codes: np.ndarray, least: float):
    """Linked pairs (i, j) of one group that are counted here: positions into the group's rows."""
    homes = np.flatnonzero(home)
    for lo in range(0, len(rep), BLOCK):
        part = np.arange(lo, min(lo + BLOCK, len(rep)))
        cos = unit[part] @ unit[homes].T
        i, j = np.nonzero(cos >= least)
        i, j = part[i], homes[j]
        # one of each pair: both at home -> the smaller first; a guest before the host
        ok = np.where(home[i], rep[i] < rep[j], rep[i] != rep[j])
        lower, upper = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
        ok &= (lower == pair[0]) & (upper == pair[1])
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 15):
            a, b = i[s: s + (1 << 15)], j[s: s + (1 << 15)]
            flip = rep[a] > rep[b]
            x, y = np.where(flip, b, a), np.where(flip, a, b)
            met = _met(codes[x], codes[y])
            first = (met[:, :t] == 0).all(axis=1)
            here = np.where(home[a], met[:, t] == 1, np.where(flip, met[:, t] == 3, met[:, t] == 2))
            yield a[first & here], b[first & here]


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept."""
    v = F.col(vec_col).cast("array<double>")
    ok = (F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
          & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
          & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(ok, v).alias("v")), "vectors")
    named = rows.withColumn("h", F.sha2(F.to_json(F.struct(F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))), 256))
    groups = stored(named.where("v is not null").groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "groups")

    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    hashed = stored(_hashed(groups.select("rep", "n", "v"), kind), "hashed")
    large = _places(hashed, False).groupBy("t", "bucket", "dim").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    large = stored(large.select("t", "bucket", "dim", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "large")
    met = _places(hashed, True).join(large, ["t", "bucket", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "bucket", "dim", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                     "block", "home", "rep", "n", "vec", "axes")
    met = met.repartition("t", "bucket", "dim", "p", "q").sortWithinPartitions("t", "bucket", "dim", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pressroom.llm.common import groups_of

        for key, tab in groups_of(batches, 5):
            home = tab.column("home").to_numpy(zero_copy_only=False)
            if tab.num_rows < 2 or not home.any():
                continue
            rep, n, block = (tab.column(c).to_numpy() for c in ("rep", "n", "block"))
            unit = _units(tab.column("vec").to_pylist(), kind)
            codes = _decoded(tab.column("axes").to_pylist(), key[2])
            count = np.zeros(len(rep), np.int64)
            root = list(range(len(rep)))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for a, b in _links(key[0], home, block, (key[3], key[4]), rep, unit, codes, least):
                np.add.at(count, a, n[b])
                np.add.at(count, b, n[a])
                for i, j in zip(a.tolist(), b.tolist()):
                    i, j = find(i), find(j)
                    if i != j:
                        root[max(i, j)] = min(i, j)
            hit = np.flatnonzero(count)
            if len(hit):
                top = np.array([find(i) for i in hit.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(count[hit]), pa.array(rep[top])],
                                                 names=["rep", "links", "root"])

    found = stored(met.mapInArrow(run, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of = (groups.select("h", "rep", "n").join(links, "rep", "left")
          .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left"))
    of = of.select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = named.join(of, "h", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "id").alias("component_id"),
                      F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept"))


def q_op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def sql_op5() -> str:
    # on this table hashing finds every pair (recall is measured in the tests), so all pairs are the answer
    return """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
r(n, m) AS (SELECT vec_id, vec_id FROM ok UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, v.vec_id) AS component_id,
  coalesce(component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c ON c.n = v.vec_id LEFT JOIN k ON k.a = v.vec_id"""
