"""The corpus pipeline: documents to packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs being what the stage
before kept (at first the table ``documents``), and returns a table with the columns of ``documents``, the
last one the pieces of the packed sequences.  ``run`` applies them in order, each result written as
Parquet in the shared folder and read again.

Toxicity drops the documents it rejects.  The n-gram join keeps the document with the smallest id
(then the smallest key) of each group of similar ones; documents without words are no group.  Substring
dedup cuts long spans that start in an earlier document out of the text; a text it takes whole stays
as an empty text.  Decontamination drops documents that hold a window of a benchmark item.  Rows
with a null id or text pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import decontam, jaccard, packing, substring, toxicity
from pressroom.llm.common import doc_key, read, stored, without
from pressroom.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None       # compression lengths and token ids have no SQL form


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    groups = jaccard.similar(docs).where("n_shingles > 0 and component_id is not null")
    first = F.min(F.struct(F.coalesce("id", F.lit(2 ** 63 - 1)).alias("id"), "_k"))
    # by the component, not by its smallest id, which another component may share
    keep = groups.groupBy("component").agg(first.alias("first")).select("component", F.col("first._k").alias("keep"))
    gone = stored(groups.join(keep, "component").where("_k <> keep").select(F.col("_k").alias("k")).distinct(), "gone")
    named = docs.select(doc_key().alias("_k"), *COLUMNS)
    rest = without(named, gone)
    # rows repeated whole share a key: one of them stays (rows without words stay all)
    again = groups.groupBy("_k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_k").alias("k"))
    again = stored(again, "again")
    repeated = rest.join(again.withColumnRenamed("k", "_k"), "_k", "left_semi").dropDuplicates(["_k"]) if again.head(1) else None
    out = rest if repeated is None else without(named, gone.union(again)).unionByName(repeated)      # one filter, not two on each other
    return out.select(*COLUMNS)


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = substring.dedup(docs, carry=("doc_id", "lang", "source", "n_chars"))
    return out.select("carried.doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source",
                      F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    hit = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")).where("places is not null").select(F.col("_k").alias("k"))
    return without(docs.select(doc_key().alias("_k"), *COLUMNS), stored(hit, "hit")).select(*COLUMNS)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, special_tokens=True)


STAGES = [
    ("toxicity", stage_toxicity),
    ("ngram_join", stage_ngram_join),
    ("substring_dedup", stage_substring_dedup),
    ("decontaminate", stage_decontaminate),
    ("pack", stage_pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
