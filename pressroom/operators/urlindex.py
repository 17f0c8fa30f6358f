"""An index of the URLs that a store holds (J1, A9, N5, R1): bucketed by hash and added to run by run.

A batch reads only the buckets that its own URLs fall in, so novelty does not read the whole store.
Layout: ``<path>/n=<buckets>/bucket=<b>/run=<run>``, sorted by URL within a file; ``<path>_runs`` holds an
empty marker for each run that is indexed whole, made after its files.  The index may lag behind the
store (a job cut off between the two), never lead it: :func:`catch_up` adds the runs without a marker.

:func:`compact` merges the runs of all buckets once there are more than a few, so the files that a batch
opens are bounded by its buckets and do not grow with the number of runs.  The last run of each
stream is never merged, as a stream may replay it.  Merged files are written before the old ones are
deleted: a job cut off in between leaves some URLs twice, which a look-up does not mind.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16    # for a new index of a small store; a bucket should hold some million URLs
MOST_RUNS = 8   # runs that are not merged yet


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of a folder's entries (none if there is no folder)."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(n[len(prefix):] for n in names if n.startswith(prefix))


def runs_of(spark: SparkSession, store_path: str) -> list[str]:
    """The runs that a store partitioned by ``run`` holds."""
    return [unquote(n) for n in _names(spark, store_path, "run=")]


class UrlIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        have = _names(spark, path, "n=")
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = int(have[0]) if have else buckets      # an index keeps the number it began with
        self.root = f"{self.path}/n={self.buckets}"

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def runs(self) -> set[str]:
        """The runs that are indexed whole."""
        return {unquote(n) for n in _names(self.spark, self.path + "_runs", "run=")}

    def add(self, urls: DataFrame, run: str, url: str = "url") -> None:
        """Add the URLs of a run; the same run again replaces what it wrote."""
        new = urls.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
        self._write(new.withColumn("run", F.lit(run)))
        fs, p = _folder(self.spark, f"{self.path}_runs/run={_escaped(self.spark, run)}")
        fs.create(p, True).close()

    def _write(self, urls: DataFrame) -> None:
        rows = urls.withColumn("bucket", self.bucket(F.col("url")))
        (rows.repartition("bucket").sortWithinPartitions("bucket", "run", "url").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(self.root))

    def catch_up(self, store_path: str, url: str = "url", but: str | None = None) -> None:
        """Index the store's runs that have no marker (all but ``but``, which is being written)."""
        done = self.runs()
        late = [r for r in runs_of(self.spark, store_path) if r not in done and r != but]
        for run in late:
            rows = self.spark.read.schema(f"`{url}` string, run string").parquet(store_path).where(F.col("run") == run)
            self.add(rows, run, url)

    def known(self, asked: DataFrame, url: str = "url", but: str | None = None) -> DataFrame:
        """The indexed URLs of the buckets that ``asked`` falls in, without those of the run ``but``."""
        hit = {r[0] for r in asked.select(self.bucket(F.col(url)).alias("b")).distinct().collect()}     # at most ``buckets`` numbers
        paths = [f"{self.root}/bucket={b}" for b in map(int, _names(self.spark, self.root, "bucket=")) if b in hit]
        schema = "url string, bucket int, run string"
        if not paths:
            return self.spark.createDataFrame([], schema).select("url")
        rows = self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths)
        return (rows if but is None else rows.where(F.col("run") != but)).select("url")

    def compact(self, most: int = MOST_RUNS) -> bool:
        """Merge the runs if more than ``most`` can be; whether it did."""
        folders = {b: [unquote(n) for n in _names(self.spark, f"{self.root}/bucket={b}", "run=")] for b in _names(self.spark, self.root, "bucket=")}
        last: dict[str, str] = {}
        for run in self.runs():         # of all runs of a stream, also of such as added no URL
            stream = run.rpartition("-")[0]
            last[stream] = max(last.get(stream, ""), run)
        keep = set(last.values())
        old = {r for runs in folders.values() for r in runs} - keep
        if len(old) <= most:
            return False
        rows = self.spark.read.schema("url string, bucket int, run string").parquet(self.root).where(F.col("run").isin(sorted(old)))
        self._write(rows.select("url").distinct().withColumn("run", F.lit(f"merged-{uuid.uuid4().hex}")))
        for b, runs in folders.items():
            for run in runs:
                if run in old:
                    fs, p = _folder(self.spark, f"{self.root}/bucket={b}/run={_escaped(self.spark, run)}")
                    fs.delete(p, True)
        return True


def _escaped(spark: SparkSession, name: str) -> str:
    """A partition value as Spark writes it in a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
