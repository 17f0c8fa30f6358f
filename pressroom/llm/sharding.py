"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded random order; row r of n gets the fractional rank
(2 r - 1) / (2 n); all rows are sorted by fractional rank and the sequence is cut into shards of
equal count, so every shard holds every source in the proportion of the whole.

No sort is global: both ranks are counted as (rows in earlier buckets) + (place in the bucket).
The buckets of the first are (source, three hex digits of the seeded hash), those of the second are
slices of the fractional rank; either holds about 1/4096 of a source or of the table, so a source
with a third of the rows is spread over 4096 groups.

Defined results: a null text has size 16 and crc32 0, the empty text the same; null sources form a
source of their own; repeated rows are rows of their own, in an arbitrary order among equals (any
order of equal rows gives the same result); a null id is ordered as the text ''; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.common import read, stored

SLICES = 4096     # slices of the fractional rank; the hash buckets are 16 ** 3


def interleave(rows: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id",
               stratum: str = "source") -> DataFrame:
    """``rows`` with columns shard and slot; counts of shards differ by one at most."""
    row = F.col("_row")
    ident = row[id_col]
    source = row[stratum]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))
    named = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")).select(
        "_row", source.isNull().alias("_null"), F.coalesce(source.cast("string"), F.lit("")).alias("_src"),
        key.alias("_key")).withColumn("_b", F.substring("_key", 1, 3))
    group = ["_null", "_src", "_b"]

    # small tables: one row for each (source, hash bucket), one for each slice
    counts = named.groupBy(*group).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_null", "_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
                            F.sum("_n").over(Window.partitionBy("_null", "_src")).alias("_total"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_key", ident))
    ranked = named.withColumn("_r", place).join(offsets, group).withColumn(
        "_frac", (2 * (F.col("_before") + F.col("_r")) - 1) / (2 * F.col("_total")))
    ranked = stored(ranked.withColumn("_slice", F.floor(F.col("_frac") * SLICES).cast("int")), "ranked")

    per_slice = ranked.groupBy("_slice").agg(F.count("*").alias("_n"))
    total = per_slice.agg(F.sum("_n").alias("_all"))
    before = per_slice.select(
        "_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
                             F.lit(0)).alias("_ahead"))                    # at most SLICES rows
    before = before.crossJoin(F.broadcast(total))                          # one row
    order = Window.partitionBy("_slice").orderBy("_frac", "_null", "_src", "_key", ident)
    pos = ranked.withColumn("_p", F.row_number().over(order)).join(F.broadcast(before), "_slice").withColumn(
        "_p", F.col("_ahead") + F.col("_p") - 1)
    # row p of N goes to the shard floor(p * shards / N), whose first row is ceil(shard * N / shards)
    pos = pos.withColumn("shard", F.expr(f"cast((_p * {shards}) div _all as int)"))
    pos = pos.withColumn("slot", F.expr(f"_p - (cast(shard as bigint) * _all + {shards - 1}) div {shards}"))
    return pos.select(*[row[c].alias(c) for c in rows.columns if c not in ("shard", "slot")], "shard", "slot")


def q_op7_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return interleave(rows, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def sql_op7() -> str:
    # crc32 over the bytes of the text, in the bitwise form of the standard: 8 steps a byte by a table
    table = ("(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _k: "
             "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))")
    return f"""
WITH tab AS MATERIALIZED (SELECT {table} AS ct),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, hex(encode(coalesce(text, ''))) AS hx FROM documents),
m AS (SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS nl, source, length(hx) // 2 + 16 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hx, '..'),
      lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, ct[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32,
  md5('7:' || coalesce(doc_id::VARCHAR, '')) AS k FROM d, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY nl, s ORDER BY k, doc_id) AS r,
        count(*) OVER (PARTITION BY nl, s) AS n FROM m),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, nl, s, k, doc_id) - 1 AS p,
        count(*) OVER () AS a FROM r),
h AS (SELECT *, ((p * 40) // a)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard,
  (p - (shard::BIGINT * a + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM h"""
