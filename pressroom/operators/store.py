"""The article store: known URLs, novelty, missing texts, CSV import / export.

The store's own tables are Parquet, tied together by run commits (:mod:`runstore`).  CSV is the
interchange format of the stories file (S1 / S2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions import text as T
from pressroom.operators.numbering import number_rows
from pressroom.schemas import ARTICLE_FIELDS


def known_urls(articles: DataFrame, url: str = "url") -> DataFrame:
    """Distinct non-blank URLs of the store."""
    return articles.select(F.col(url).alias("url")).where(F.col("url") != "").distinct()


def novelty(stubs: DataFrame, articles: DataFrame, url: str = "url", normalize: bool = False) -> DataFrame:
    """Stubs whose URL is not in the store (exact string; ``normalize``
    compares fetch-cleaned keys on both sides instead)."""
    known = known_urls(articles)
    if not normalize:
        return stubs.join(known, stubs[url] == known["url"], "left_anti")
    k = known.select(T.url_fetch_clean("url").alias("_k"))
    return stubs.join(k, T.url_fetch_clean(stubs[url]) == F.col("_k"), "left_anti")


def mark_known(stubs: DataFrame, articles: DataFrame, url: str = "url") -> DataFrame:
    """Stubs with ``in_store`` (left join on the distinct known set)."""
    known = known_urls(articles).withColumnRenamed("url", "_known_url").withColumn("_hit", F.lit(True))
    return (stubs.join(known, stubs[url] == F.col("_known_url"), "left")
            .withColumn("in_store", F.coalesce(F.col("_hit"), F.lit(False)))
            .drop("_known_url", "_hit"))


def missing_texts(articles: DataFrame, texts: DataFrame, overwrite: bool = False) -> DataFrame:
    """Article rows without a text row (all rows with ``overwrite``)."""
    if overwrite:
        return articles
    have = texts.where(F.col("text") != "").select("row_num").distinct()
    return articles.join(have, "row_num", "left_anti")


def read_stories_csv(spark: SparkSession, path: str) -> DataFrame:
    """The stories CSV by header name; absent columns read as ''.

    All columns are strings; quoted commas, doubled quotes and newlines inside
    fields are kept.  ``row_num`` is the 1-based position of the record in
    the file (file order), url is stripped of blanks and then of quotes,
    paywalled is normalised.
    """
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .option("mode", "PERMISSIVE").csv(path))
    have = set(raw.columns)
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
            for c in ARTICLE_FIELDS]
    d = raw.select(*cols, F.col("_metadata.file_path").alias("_file"))
    d = (d.withColumn("url", T.url_store_clean("url"))
          .withColumn("paywalled", T.paywalled_norm("paywalled")))
    # Record order: a multi-line CSV file is read by one task, in file order.
    d = d.withColumn("_pos", F.monotonically_increasing_id())
    return number_rows(d, ["_file", "_pos"], base=1).select("row_num", *ARTICLE_FIELDS)


def write_stories_csv(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The seven columns in file order, header, every field kept verbatim.

    Rows are range-partitioned and sorted on ``row_num``, so the part files,
    read in name order (as :func:`read_stories_csv` does), hold the rows in
    row order; no single task writes the whole table.
    """
    (articles.orderBy("row_num").select(*ARTICLE_FIELDS).write.mode(mode)
     .option("header", True).option("escape", '"').option("quoteAll", False)
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def text_key(row_num) -> F.Column:
    """S3: text name of a row, zero-padded to at least three digits."""
    return F.concat(T.row_key_name(row_num), F.lit(".txt"))


def read_texts_folder(spark: SparkSession, path: str) -> DataFrame:
    """S3 import: one text file per row named NNN.txt -> (row_num, text)."""
    raw = spark.read.option("wholetext", True).text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.txt$", 1)
    return (raw.select(name.alias("n"), F.col("value").alias("text"))
            .where(F.col("n") != "")
            .select(F.col("n").cast("long").alias("row_num"), "text"))
