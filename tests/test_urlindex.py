"""The index of known URLs: buckets hit, files read, replay, merging, catching up with a store."""

from pyspark.sql import functions as F

from pressroom.operators.urlindex import UrlIndex


def _urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def _known(index, asked, but=None):
    return {r.url for r in index.known(asked, but=but).collect()}


def test_files_read_do_not_grow_with_the_runs(spark, tmp_path):
    index = UrlIndex(spark, str(tmp_path / "urls"), buckets=16)
    asked = _urls(spark, ["u1-0", "new"])
    hit = asked.select(index.bucket(F.col("url"))).distinct().count()
    assert index.known(asked).count() == 0                                # no index yet
    every = set()
    for run in range(7):
        names = [f"u{run}-{i}" for i in range(40)] + ["", None]
        every |= set(names[:41])
        index.add(_urls(spark, names), f"s-{run:09d}")
        index.compact(most=2)
        files = index.known(asked).inputFiles()
        assert len(files) <= hit * (1 + 2 + 1)                            # merged, two more, the last
    assert _known(index, _urls(spark, sorted(every))) == every
    assert "u1-0" in _known(index, asked) and "new" not in _known(index, asked)
    # the last run is never merged, so a replay can leave it out
    assert _known(index, _urls(spark, sorted(every)), but="s-000000006") == {u for u in every if not u.startswith("u6-")}
    again = UrlIndex(spark, str(tmp_path / "urls"), buckets=99)
    assert again.buckets == 16 and again.runs() == {f"s-{i:09d}" for i in range(7)}


def test_catches_up_with_a_store(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("a", 1, "old: 1"), ("b", 2, "old: 1"), ("", 3, "x"), ("c", 4, "x"), ("d", 5, "now")]
    spark.createDataFrame(rows, "url string, row_num long, run string").write.partitionBy("run").parquet(store)
    index = UrlIndex(spark, str(tmp_path / "urls"), buckets=4)
    index.catch_up(store, but="now")
    asked = _urls(spark, ["a", "b", "c", "d", "", None])
    assert index.runs() == {"old: 1", "x"}
    assert _known(index, asked) == {"a", "b", "c", ""}
    index.catch_up(store)
    assert _known(index, asked) == {"a", "b", "c", "d", ""}
