"""Driver contract: entry() runs on sf0.001; every oracle key is a query key."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["row_num", "date", "outlet"]


def test_registry_shapes():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


def test_some_queries_at_smoke_scale(spark):
    for k in ("rss_items", "anchor_list", "theme_guess", "audit_render", "page_stop", "result_list"):
        assert E.queries()[k](spark, E.SMOKE_DIR).count() >= 0
