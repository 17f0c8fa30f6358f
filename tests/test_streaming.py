"""Incremental ingest keeps the first unseen row per URL, numbers on, and is replay-safe."""

from pyspark.sql import functions as F

from pressroom.streaming.ingest import make_batch_writer, run_available

SCHEMA = "page_id long, url string"


def _store(spark, path):
    return sorted((r.row_num, r.page_id, r.url) for r in spark.read.parquet(path).collect())


def test_ingest_runs_and_replay(spark, tmp_path):
    landing, store, ckpt = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")
    # duplicates inside one delivery (u1 twice: the lower page_id wins) and across deliveries (u2)
    spark.createDataFrame([(3, "u1"), (1, "u1"), (2, "u2")], SCHEMA).write.parquet(landing, mode="append")
    run_available(spark, landing, spark.createDataFrame([], SCHEMA).schema, store, ckpt)
    spark.createDataFrame([(4, "u2"), (6, "u4"), (5, "u3")], SCHEMA).write.parquet(landing, mode="append")
    run_available(spark, landing, spark.createDataFrame([], SCHEMA).schema, store, ckpt)
    got = _store(spark, store)
    assert got == [(1, 1, "u1"), (2, 2, "u2"), (3, 5, "u3"), (4, 6, "u4")]
    # nothing landed: a third run changes nothing
    run_available(spark, landing, spark.createDataFrame([], SCHEMA).schema, store, ckpt)
    assert _store(spark, store) == got
    # replaying the last batch (same id, same rows) rewrites only its partition, with the same numbers
    last = spark.read.parquet(store).where("run like '%-000000001'").select("page_id", "url", "run").collect()
    stream = last[0].run[:-10]
    make_batch_writer(store, stream=stream)(spark.createDataFrame([r[:2] for r in last], SCHEMA), 1)
    assert _store(spark, store) == got
    # a replayed delivery and a new one: only the new URL is added, numbered on
    spark.createDataFrame([(7, "u5"), (8, "u1"), (9, "u3")], SCHEMA).write.parquet(landing, mode="append")
    run_available(spark, landing, spark.createDataFrame([], SCHEMA).schema, store, ckpt)
    assert _store(spark, store)[-1] == (5, 7, "u5")
    assert spark.read.parquet(store).agg(F.max("row_num")).first()[0] == 5


def test_new_checkpoint_keeps_the_store(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame([(1, "u1"), (2, "u2")], SCHEMA).write.parquet(landing, mode="append")
    run_available(spark, landing, schema, store, str(tmp_path / "ck1"))
    spark.createDataFrame([(3, "u3")], SCHEMA).write.parquet(landing, mode="append")
    run_available(spark, landing, schema, store, str(tmp_path / "ck2"))      # reads everything again
    assert _store(spark, store) == [(1, 1, "u1"), (2, 2, "u2"), (3, 3, "u3")]


def test_seeded_from_existing_store(spark, tmp_path):
    from pressroom.streaming.ingest import seed_store

    landing, store, ckpt = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")
    existing = spark.createDataFrame([(None, "u1", 1), (None, "u2", 2)], "page_id long, url string, row_num long")
    seed_store(existing, store, 2)
    spark.createDataFrame([(10, "u2"), (11, "u9")], SCHEMA).write.parquet(landing, mode="append")
    run_available(spark, landing, existing.select("page_id", "url").schema, store, ckpt)
    assert [x for x in _store(spark, store) if x[0] > 2] == [(3, 11, "u9")]


def test_store_of_another_writer_is_numbered_on(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(None, "u1", 1), (None, "u2", 2)], "page_id long, url string, row_num long").write.parquet(f"{store}/run=old")
    for n, rows in enumerate(([(1, "u1"), (2, "u3")], [(3, "u4")])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(landing, mode="append")
        run_available(spark, landing, spark.createDataFrame([], SCHEMA).schema, store, str(tmp_path / "ck"))
    assert [(n, u) for n, _, u in sorted(((r.row_num, r.page_id, r.url) for r in spark.read.parquet(store).collect()))] == [
        (1, "u1"), (2, "u2"), (3, "u3"), (4, "u4")]
