"""Helpers shared by the operators: tables on disk between steps, words of a text
as numpy arrays, connected components by joins."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.session import shared_path

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ODD = U64(0x9E3779B97F4A7C15)


ARROW_ROWS = 500        # rows of texts in one Arrow batch


def small_batches(spark: SparkSession) -> None:
    """Texts are long: a batch of Spark's default 10,000 rows of them is tens of MB, held several
    times by the JVM and by Python.  Lower the session's setting if it is above ``ARROW_ROWS``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: what
    follows reads the files, so a lost executor costs no recomputation, later scans
    prune columns, and lineage ends here."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, f"llm-{uuid.uuid4().hex}/{name}")
    df.write.parquet(path)
    if free:
        # Spark frees the shuffle files of finished steps when the driver's collector finds their
        # plans gone; nothing needs them any more, so it is asked to look now
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stored` that no later step reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row for joins inside an operator; repeated rows share it and get equal results,
    rows with a null or repeated id but another text do not."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0 (a null id counts as the empty text: crc 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads each input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX1
        x = (x ^ (x >> U64(27))) * _MIX2
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)   # a random 64-bit number for each byte value
_POWERS = {"a": np.ones(1, U64), "inv": np.ones(1, U64)}
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i up to n; kept between calls."""
    have = len(_POWERS["a"])
    if have <= n:
        with np.errstate(over="ignore"):
            for k, b in (("a", _BASE), ("inv", _BASE_INV)):
                f = np.full(max(n + 1, 1 << 16), b, U64)
                f[0] = 1
                _POWERS[k] = np.cumprod(f, dtype=U64)
    return _POWERS["a"], _POWERS["inv"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span, by prefix sums of a polynomial."""
    a, inv = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        p = np.empty(len(buf) + 1, U64)
        p[0] = 0
        np.cumsum(_BYTE[buf] * a[: len(buf)], dtype=U64, out=p[1:])
        h = (p[ends] - p[starts]) * inv[starts]
        return mix(h ^ mix((ends - starts).astype(U64) * _ODD))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries of ``h`` (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for j in range(k):
            out = out * _BASE + mix(h[j: j + n] + U64(j) * _ODD)
        return mix(out + U64(k))


def _table(keep) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(keep)] = True
    return t


#: Byte classes of the two word patterns; both hold every byte of a non-ASCII character.
NON_SPACE = _table(set(range(256)) - {0x20, 9, 10, 11, 12, 13})
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(buf: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of bytes in the class ``keep``."""
    m = np.zeros(len(buf) + 2, np.int8)
    m[1:-1] = keep[buf]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(offs):
        offs = np.zeros(1, np.int64)
    return buf[offs[0]: offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds few bytes of text (a longer single row stays whole).  At the end
    Arrow gives back the memory that it keeps for later batches: Spark's Python workers outlive their task."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = text_buffer(b.column(b.schema.get_field_index(text)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
    b = None
    pa.default_memory_pool().release_unused()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Connected components of an edge table: (node, component), component the smallest
    node reachable.  Alternating large-star and small-star rounds: each round is two
    grouped minima (partially aggregated before the shuffle) and joins; edges contract
    to stars in a number of rounds that grows with the logarithm of the size.  Each
    round is written to the shared folder.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    e = stored(e, "edges", free=False)
    sig = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    seen = sig(e)
    for i in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stored(large, f"large{i}", free=False)
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        new = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        new = stored(new, f"small{i}", free=False)
        now = sig(new)
        done, seen = now == seen, now
        discard(large, e)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def spaced(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column with one space after each row, and where the rows begin
    (n + 1 offsets; the row i is buf[offs[i]: offs[i + 1] - 1])."""
    buf, offs = text_buffer(col)
    n = len(offs) - 1
    new = offs + np.arange(n + 1)
    out = np.full(int(new[-1]), 0x20, np.uint8)
    for i in range(n):
        out[new[i]: new[i + 1] - 1] = buf[offs[i]: offs[i + 1]]
    return out, new


def row_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offs, starts, "right") - 1


#: Letters A-Z in lower case and nothing else, as the contracts ask.
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, the first exactly and the others also where both are null; the keys of
    the right side are dropped."""
    other = right.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.col(keys[0]) == F.col(f"_r{keys[0]}")
    for k in keys[1:]:
        on = on & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return left.join(other, on, how).drop(*[f"_r{k}" for k in keys])


def first_by_hash(rows: DataFrame, group: str, hash_col: str, limit: Column, salts: int = 64) -> DataFrame:
    """The first ``limit`` rows of each group in the order of a hash, over all rows.  Taken in two
    steps, first within (group, salt), so that a large group meets in one task only as
    salts * limit rows."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(hash_col))
    few = rows.withColumn("_salt", F.pmod(F.col(hash_col), F.lit(salts))).withColumn("_r", r).where(F.col("_r") <= limit)
    r = F.row_number().over(Window.partitionBy(group).orderBy(hash_col))
    return few.withColumn("_r", r).where(F.col("_r") <= limit).drop("_r", "_salt")


def groups_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of rows with equal first ``n_keys`` integer columns, of input sorted by them.
    At most one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(n_keys)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            this = tuple(int(c[lo]) for c in cols)
            if key is not None and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


FILTER_BITS = 26        # log2 of the bits of a key filter: 8 MB, whatever the number of keys


class KeyFilter:
    """A bit map of fixed size of some documents' keys, for the tasks that read the documents: what it
    does not flag is none of them, what it flags is joined with the keys exactly.  So texts of
    documents that have nothing to do with a step need not be shuffled for it."""

    def __init__(self, keys: DataFrame, key: str = "k"):
        import zlib

        h = F.xxhash64(F.col(key), F.lit(8))
        at = F.shiftrightunsigned(h, 64 - FILTER_BITS)
        mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{key}`, 8), {64 - FILTER_BITS}) & 63 as int))")
        got = keys.select(F.shiftright(at, 6).alias("w"), mask.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
        bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)      # at most so many rows came back
        bits[got["w"].to_numpy()] = got["v"].to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))

    def split(self, docs: DataFrame, flagged: bool, key: str = "_k", then=None, schema: str | None = None) -> DataFrame:
        """The rows of ``docs`` that are (or are not) flagged, or what ``then`` makes of their batches: in the
        same Python worker, not in one more for each task."""
        sent = self.sent

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zlib

            table = np.frombuffer(zlib.decompress(sent.value), U64)
            for b in batches:
                h = b.column(b.num_columns - 1).to_numpy().view(U64) >> U64(64 - FILTER_BITS)
                hit = (table[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1
                take = hit == flagged
                if take.any():
                    yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(take))

        return docs.withColumn("_h", F.xxhash64(F.col(key), F.lit(8))).mapInArrow(
            (lambda batches: then(kept(batches))) if then else kept, schema or docs.schema)

    def flagged(self, key: str = "_k") -> Column:
        """Whether the row is flagged; only the key's hash goes to Python and only the flag comes back."""
        sent = self.sent

        def run(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import zlib

            table = np.frombuffer(zlib.decompress(sent.value), U64)
            for col in hashes:
                h = col.to_numpy().view(U64) >> U64(64 - FILTER_BITS)
                yield pa.array((table[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1)

        run.__annotations__ = {"hashes": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "boolean")(F.xxhash64(F.col(key), F.lit(8)))


def with_some(docs: DataFrame, some: DataFrame, then, schema: str, key: str = "_k", other: str = "k") -> DataFrame:
    """What ``then`` makes of the batches of the left join of ``docs`` with ``some`` (one row for each key; its
    columns come last).  Only the documents which may have a row there are shuffled, and no task runs the filter
    and ``then`` in two Python workers: an executor keeps as many workers as it once had, each with its memory."""
    f = KeyFilter(some, other)
    right = some.withColumnRenamed(other, "_other")
    # a broadcast join would put the filter and ``then`` into one task
    hit = f.split(docs, True, key).join(right.hint("merge"), F.col(key) == F.col("_other"), "left").drop("_other")
    rest = docs
    for c in right.columns:
        if c != "_other":
            rest = rest.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    return hit.mapInArrow(then, schema).unionByName(f.split(rest, False, key, then, schema))


def without(docs: DataFrame, keys: DataFrame, key: str = "_k", other: str = "k") -> DataFrame:
    """The rows of ``docs`` whose key is not in ``keys``; only rows that may be are shuffled, and texts stay in the JVM."""
    flag = KeyFilter(keys, other).flagged(key)
    right = keys.select(F.col(other).alias("_other")).distinct()
    hit = docs.where(flag).join(right, F.col(key) == F.col("_other"), "left_anti")
    return hit.unionByName(docs.where(~flag))
