"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql.types import (
    IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, L = StringType(), IntegerType(), LongType()

# The stories table columns, in file order.
ARTICLE_FIELDS = ["date", "outlet", "title", "url", "theme", "summary", "paywalled"]

OUTLETS = _s(("key", S), ("ord", I), ("name", S), ("domain", S), ("status", S), ("search", S),
             ("min_chars", I), ("lane", S))
STUBS = _s(("run_id", S), ("outlet_key", S), ("outlet_ord", I), ("page_no", I), ("stub_ord", I),
           ("url", S), ("title", S), ("date", S))
PAGES = _s(("url", S), ("html", S))
REDIRECTS = _s(("from_url", S), ("to_url", S))
FEEDS = _s(("feed_id", S), ("outlet_key", S), ("xml", S))
ARTICLES = _s(("row_num", L), *[(c, S) for c in ARTICLE_FIELDS])
TEXTS = _s(("row_num", L), ("text", S))
RUNS = _s(("run_id", S), ("ts", TimestampType()), ("query", S), ("project_context", S))
OUTLET_RESULTS = _s(("run_id", S), ("outlet", S), ("pages", L), ("hits", L), ("new", L), ("added", L),
                    ("note", S))
THEMES = _s(("theme", S), ("theme_ord", I), ("keyword", S))
