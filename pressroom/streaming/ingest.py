"""Incremental collection as a Structured Streaming job.

Captured pages land as Parquet files in a folder.  Each micro-batch

1. keeps, per URL, the first row in arrival order (W1, a partial aggregate) whose URL is not in
   the store yet (J1, an anti join on the buckets of the store's URL index that the batch's URLs fall in).
   The index is made from the store and caught up with it before each batch, so a stream with a new
   checkpoint, or one that continues an imported store, adds no URL twice;
2. numbers the survivors on from the last row number (A10, W3) and writes them into the store
   partition ``run`` = stream id and batch id; the last row number of each batch goes to a
   one-row-per-batch ``_runs`` table.

Replay safety: a micro-batch that runs again (a failure between the write and the commit of the
checkpoint) leaves its own partition out of the known URLs and of the numbers, and overwrites
that partition, so it writes the same rows and numbers again.  Only the last batch of a stream can
be replayed.  Partitions of other streams have other names and are never overwritten.  Everything
runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressroom.operators.discovery import first_seen
from pressroom.operators.numbering import number_rows
from pressroom.operators.urlindex import BUCKETS, UrlIndex
from pressroom.session import exists, materialize

RUNS = "last_row long, run string"


def seed_store(store: DataFrame, store_path: str, last_row_num: int, name: str = "import") -> None:
    """Begin a stream's store from existing rows (for example those of the stories CSV): they form
    the partition ``run`` = ``name``, and the numbering goes on from ``last_row_num``."""
    (store.withColumn("run", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(store_path))
    _note(store.sparkSession, store_path, last_row_num, name)


def runs_path(store_path: str) -> str:
    return store_path.rstrip("/") + "_runs"


def index_path(store_path: str) -> str:
    return store_path.rstrip("/") + "_urls"


def _note(spark: SparkSession, store_path: str, last: int, run: str) -> None:
    (spark.createDataFrame([(int(last), run)], RUNS).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(runs_path(store_path)))


def make_batch_writer(store_path: str, key: str = "url", order: Sequence[str] = ("page_id",),
                      stream: str | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the new rows of a batch, numbered, as one partition of the store.
    ``buckets``: of a URL index that is begun here."""
    order = list(order)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        run = f"{name}-{batch_id:09d}"
        # both tables exist (run_available writes a first row); a failed read is a failure
        others = spark.read.schema(RUNS).parquet(runs_path(store_path)).where(F.col("run") != run)
        base = others.agg(F.coalesce(F.max("last_row"), F.lit(0))).first()[0] + 1
        index = UrlIndex(spark, index_path(store_path), buckets)
        index.catch_up(store_path, key, but=run)
        known = index.known(batch.where(F.col(key).isNotNull()), key, but=run).select(F.col("url").alias(key))
        firsts = first_seen(batch.where(F.col(key).isNotNull()), [key], order)
        new = materialize(firsts.join(known, key, "left_anti"))
        count = new.count()
        numbered = number_rows(new, order, base=base).withColumn("run", F.lit(run))
        (numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run").parquet(store_path))
        index.add(new, run, key)
        _note(spark, store_path, base - 1 + count, run)    # numbers are contiguous from base
        index.compact()

    return write


def run_available(spark: SparkSession, landing: str, schema: StructType, store_path: str,
                  checkpoint: str, key: str = "url", order: Sequence[str] = ("page_id",),
                  project: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> None:
    """Process every file that has landed and is not yet processed, then stop.  A store that this module did
    not write (partitions by ``run``, no record of runs) is numbered on from its largest row number."""
    src = spark.readStream.format("parquet").schema(schema).load(landing)
    rows = project(src) if project else src
    empty = spark.createDataFrame([], rows.schema).withColumn("row_num", F.lit(None).cast("long"))
    empty.write.mode("overwrite").parquet(store_path.rstrip("/") + "/run=begin")
    if not exists(spark, runs_path(store_path) + "/run=begin"):
        last = spark.read.schema("row_num long, run string").parquet(store_path).agg(F.max("row_num")).first()[0]
        _note(spark, store_path, last or 0, "begin")
    q = (rows.writeStream
         .foreachBatch(make_batch_writer(store_path, key, order, buckets=buckets))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
