"""Stories CSV import / export, texts folder, numbering, novelty."""

import os
import random

from pyspark.sql import functions as F

from pressroom.operators.numbering import number_rows
from pressroom.operators.store import (
    known_urls, missing_texts, novelty, read_stories_csv, read_texts_folder, write_stories_csv,
)
from pressroom.schemas import ARTICLE_FIELDS

HERE = os.path.dirname(os.path.abspath(__file__))


def test_read_stories_csv_traps(spark):
    rows = [r.asDict() for r in read_stories_csv(spark, f"{HERE}/fixtures/stories.csv").orderBy("row_num").collect()]
    assert [r["row_num"] for r in rows] == [1, 2, 3, 4]
    r1 = rows[0]
    assert r1["title"] == "Title, with comma"
    assert r1["url"] == "https://a.example/1"           # blanks, then quotes stripped
    assert r1["summary"] == 'Line one\nline "two"'      # newline and doubled quote inside a field
    assert r1["paywalled"] == "yes"
    assert rows[1]["date"] == "2024-03" and rows[1]["paywalled"] == "no" and rows[1]["theme"] == ""
    assert rows[2]["paywalled"] == "no"
    assert rows[3]["title"] == "Short row" and rows[3]["url"] == "" and rows[3]["paywalled"] == "no"
    assert set(rows[0]) == {"row_num", *ARTICLE_FIELDS}    # extra column ignored


def test_stories_roundtrip(spark, tmp_path):
    data = [(i + 1, "2024-01-0%d" % (i % 9 + 1), "o", f'T "{i}", x', f"https://x/{i}", "",
             "multi\nline, \"q\"" if i % 2 else "", "no") for i in range(25)]
    df = spark.createDataFrame(data, "row_num long, " + ", ".join(f"{c} string" for c in ARTICLE_FIELDS))
    path = str(tmp_path / "s")
    write_stories_csv(df.repartition(3), path)
    back = read_stories_csv(spark, path).orderBy("row_num").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("row_num").collect()]


def test_texts_folder(spark):
    got = sorted(tuple(r) for r in read_texts_folder(spark, f"{HERE}/fixtures/texts").collect())
    assert got == [(1, "one"), (1234, "big")]


def test_number_rows_contiguous_and_partition_independent(spark):
    rnd = random.Random(7)
    data = [(rnd.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(data, "g int, i int")
    expect = {(g, i): n + 10 for n, (g, i) in enumerate(sorted(data))}
    for parts in (1, 3, 8):
        got = number_rows(df.repartition(5), ["g", "i"], base=10, num_partitions=parts).collect()
        assert {(r.g, r.i): r.row_num for r in got} == expect


def test_number_rows_empty(spark):
    df = spark.createDataFrame([], "g int")
    assert number_rows(df, ["g"], base=1).count() == 0


def test_known_urls_novelty_missing(spark):
    store = spark.createDataFrame([(1, "https://a/"), (2, ""), (3, "https://b")], "row_num long, url string")
    assert sorted(r.url for r in known_urls(store).collect()) == ["https://a/", "https://b"]
    stubs = spark.createDataFrame([("https://a",), ("https://a/",), ("https://c",)], "url string")
    assert sorted(r.url for r in novelty(stubs, store).collect()) == ["https://a", "https://c"]
    assert sorted(r.url for r in novelty(stubs, store, normalize=True).collect()) == ["https://c"]
    arts = store.withColumn("paywalled", F.lit("no"))
    texts = spark.createDataFrame([(1, "t"), (3, "")], "row_num long, text string")
    assert sorted(r.row_num for r in missing_texts(arts, texts).collect()) == [2, 3]
    assert missing_texts(arts, texts, overwrite=True).count() == 3
