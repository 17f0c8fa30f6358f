"""The run store - articles, texts and audit records tied together by run commits.

Under one folder lie the tables ``articles``, ``texts``, ``outlet_results`` and ``runs``, each
partitioned by (run_id, attempt), and a ``manifest`` with one row for each committed run.  A run is
written under a fresh attempt name, table after table; its manifest row comes last and is what makes
all four visible at once.  Readers take only the attempts that the manifest names, so

* a run cut off after any table write leaves nothing that a reader sees: run again, it finds the
  store as it was before, writes a new attempt and commits that;
* a run that is committed already is not written again (a replayed job changes nothing);
* two attempts of one run that both commit count once: the first commit stands.

A manifest row also carries the last row number and the commit's place (``seq``), so the next row
number (A10) is read from a table with one row a run, never from the articles.  A run that was
numbered on a store that has moved on since is refused at its commit; run again, it gets new numbers.
The manifest filters partitions: an attempt that is not committed is never opened.
:func:`remove_unfinished` deletes such attempts' files.

The text of a row is that of the latest committed run that wrote one (repair with ``overwrite``).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pressroom.schemas import ARTICLES, OUTLET_RESULTS, RUNS, TEXTS


def _plain(schema: StructType) -> StructType:
    return StructType([f for f in schema.fields if f.name != "run_id"])


TABLES = {"articles": ARTICLES, "texts": TEXTS,
          "outlet_results": StructType([*_plain(OUTLET_RESULTS).fields, StructField("sel_ord", IntegerType())]),
          "runs": _plain(RUNS)}
_PARTS = [StructField("run_id", StringType()), StructField("attempt", StringType())]
MANIFEST = StructType([*_PARTS, StructField("kind", StringType()), StructField("seq", LongType()), StructField("last_row", LongType())])
BEGIN = "__begin__"      # the empty run that every store begins with


class StoreMoved(RuntimeError):
    """Another run was committed after this one had read the store."""


def create(spark: SparkSession, base: str) -> None:
    """Begin an empty store; one that exists stays as it is."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/{name}/run_id={BEGIN}/attempt=0")
    spark.createDataFrame([(BEGIN, "0", "begin", 0, 0)], MANIFEST).write.mode("ignore").parquet(f"{base}/manifest")


def committed(spark: SparkSession, base: str) -> DataFrame:
    """One row for each committed run: the first commit of a run stands."""
    rows = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    first = F.min(F.struct("seq", "attempt", "kind", "last_row")).alias("m")
    return rows.groupBy("run_id").agg(first).select("run_id", "m.attempt", "m.kind", "m.seq", "m.last_row")


def is_committed(spark: SparkSession, base: str, run_id: str) -> bool:
    return bool(committed(spark, base).where(F.col("run_id") == run_id).head(1))


def _attempts(spark: SparkSession, base: str, table: str) -> DataFrame:
    schema = StructType([*TABLES[table].fields, *_PARTS])
    return spark.read.schema(schema).option("basePath", f"{base}/{table}").parquet(f"{base}/{table}")


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The rows of committed runs, with ``run_id`` and ``seq``.  The join is on partition columns, and a side
    with a filter prunes the partitions of the other at run time: only files of committed attempts are read."""
    done = committed(spark, base).where("seq >= 0").select("run_id", "attempt", "seq")
    return _attempts(spark, base, table).join(done, ["run_id", "attempt"]).drop("attempt")


def read_texts(spark: SparkSession, base: str) -> DataFrame:
    """(row_num, text): the latest committed text of each row.  Only rows that a repair wrote are compared."""
    done = committed(spark, base).where("seq >= 0")
    rows = _attempts(spark, base, "texts").join(done.select("run_id", "attempt", "seq", "kind"), ["run_id", "attempt"])
    if not done.where("kind = 'repair'").head(1):
        return rows.select("row_num", "text")
    mended = rows.where("kind = 'repair'")
    latest = mended.groupBy("row_num").agg(F.max("seq").alias("seq"))
    new = mended.join(latest, ["row_num", "seq"]).select("row_num", "text")
    return rows.where("kind <> 'repair'").join(latest, "row_num", "left_anti").select("row_num", "text").unionByName(new)


def position(spark: SparkSession, base: str) -> tuple[int, int]:
    """(place of the latest commit, last row number)."""
    r = committed(spark, base).agg(F.max("seq").alias("seq"), F.max("last_row").alias("last")).first()
    return int(r["seq"]), int(r["last"])


def begin_attempt() -> str:
    """A fresh attempt name; names sort by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, base: str, table: str, run_id: str, attempt: str) -> None:
    """One table of an attempt, in the table's columns (absent ones null).  A task that runs again writes
    the same attempt again, so the write replaces what the attempt had."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields]
    df.select(*cols).write.mode("overwrite").parquet(f"{base}/{table}/run_id={run_id}/attempt={attempt}")


def commit(spark: SparkSession, base: str, run_id: str, attempt: str, since: int, kind: str = "collect") -> bool:
    """Make an attempt visible; False if the run is committed already.  ``since`` is the place of the latest
    commit when the run read the store."""
    if is_committed(spark, base, run_id):
        return False
    seq, last = position(spark, base)
    if seq != since:
        raise StoreMoved(f"run {run_id!r} was numbered after commit {since}, the store is at {seq}")
    mine = spark.read.schema(TABLES["articles"]).parquet(f"{base}/articles/run_id={run_id}/attempt={attempt}")
    top = mine.agg(F.max("row_num")).first()[0]
    row = (run_id, attempt, kind, seq + 1, max(last, int(top or 0)))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    return True


def write_run(spark: SparkSession, base: str, run_id: str, since: int, kind: str = "collect", **tables: DataFrame) -> bool:
    """All tables of a run, then its commit.  Tables that are not given are written empty."""
    if is_committed(spark, base, run_id):
        return False
    attempt = begin_attempt()
    for name, schema in TABLES.items():
        df = tables.get(name)
        write_table(spark.createDataFrame([], schema) if df is None else df, base, name, run_id, attempt)
    return commit(spark, base, run_id, attempt, since, kind)


def remove_unfinished(spark: SparkSession, base: str) -> int:
    """Delete the files of attempts that are not committed; how many there were.  Not while a run is being written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = {(r["run_id"], r["attempt"]) for r in committed(spark, base).select("run_id", "attempt").collect()}    # one row a run
    gone = set()
    for table in TABLES:
        root = jvm.org.apache.hadoop.fs.Path(f"{base}/{table}")
        fs = root.getFileSystem(conf)
        for run in fs.listStatus(root):
            if not run.isDirectory() or not run.getPath().getName().startswith("run_id="):
                continue
            for attempt in fs.listStatus(run.getPath()):
                key = (run.getPath().getName()[len("run_id="):], attempt.getPath().getName()[len("attempt="):])
                if key not in done:
                    fs.delete(attempt.getPath(), True)
                    gone.add(key)
    return len(gone)


def import_run(spark: SparkSession, base: str, articles: DataFrame, texts: DataFrame | None = None, run_id: str = "import") -> bool:
    """S1 into the store: existing numbered articles (and texts) as one run."""
    create(spark, base)
    return write_run(spark, base, run_id, position(spark, base)[0], "import", articles=articles, **({} if texts is None else {"texts": texts}))


def audit_row(spark: SparkSession, query: str, project_context: str, ts) -> DataFrame:
    when: Column = F.current_timestamp() if ts is None else F.lit(ts).cast("timestamp")
    return spark.range(1).select(when.alias("ts"), F.lit(query).alias("query"), F.lit(project_context).alias("project_context"))
