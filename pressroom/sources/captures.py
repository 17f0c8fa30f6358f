"""Captured bytes as stored tables: pages bucketed by URL (S12, J3), bodies and sitemap indexes by year.

A look-up of candidate URLs in the captured pages is the one step that would shuffle HTML.  In a table
bucketed and sorted by URL the pages lie where the join wants them: only the candidates' URLs move.
Sitemap bodies and index entries are partitioned by the year in their path, so a search over some
years opens the files of those years only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The year that a dated sitemap's address names.
YEAR_RX = r"/sitemap/[^/]+/([0-9]{4})/"
NO_YEAR = 0


def write_pages(pages: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Captured pages as a table bucketed and sorted by URL.  ``buckets``: as many as tasks should share a
    look-up; a bucket should fit an executor's memory for sorting (some hundred MB of HTML)."""
    w = pages.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").mode("overwrite").format("parquet")
    (w.option("path", path) if path else w).saveAsTable(table)
    return pages.sparkSession.table(table)


def year_of(address: Column) -> Column:
    """The year in a dated sitemap's address, 0 for others."""
    return F.coalesce(F.regexp_extract(address, YEAR_RX, 1).try_cast("int"), F.lit(NO_YEAR))


def write_bodies(feeds: DataFrame, path: str) -> None:
    """Captured bodies (feed_id, outlet_key, kind, page_no, xml) by outlet, kind and year."""
    (feeds.withColumn("year", year_of(F.col("feed_id"))).write.mode("append").partitionBy("outlet_key", "kind", "year").parquet(path))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feed_id string, page_no int, xml string, outlet_key string, kind string, year int").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """Entries of sitemap indexes (:func:`feeds.sitemap_index`: loc, year, ...) by year."""
    index.write.mode("append").partitionBy("year").parquet(path)


def read_index(spark: SparkSession, path: str, year_from: int, year_to: int) -> DataFrame:
    """the entries of a range of years; only their partitions are listed and read."""
    return spark.read.parquet(path).where(F.col("year").between(year_from, year_to))
