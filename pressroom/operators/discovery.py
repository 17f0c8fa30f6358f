"""Order-dependent discovery rules as aggregates (W1, W4, W5) and query keywords (F1).

The reference keeps a "seen" set while walking pages and stops at the first
page that adds nothing.  Both are aggregates here: the first occurrence of a
key is ``min(struct(order..., payload...))`` per key, a hash/sort aggregate
with map-side partial combine, so a hot key (one URL repeated in a third of
all rows) is reduced before the shuffle; the pages before the stop page are numbered on the distinct
(search, page) pairs.  No window sorts the items of a search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.session import materialize as materialize_df


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys`` - the earliest by ``order`` (a total order inside a key)."""
    rest = [c for c in df.columns if c not in set(keys) and c not in set(order)]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    d = df.groupBy(*keys).agg(F.min(packed).alias("_f"))
    return d.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in list(order) + rest]).select(*df.columns)


def page_window(df: DataFrame, max_pages: int, page: str = "page_no") -> DataFrame:
    """Only pages 1..max_pages are ever requested."""
    return df.where(F.col(page).between(1, max_pages))


def result_offset(page) -> F.Column:
    """First result number requested for a page of 25 (page 1 asks for none)."""
    p = F.col(page) if isinstance(page, str) else page
    return F.when(p > 1, (p - 1) * 25 + 1)


def stop_at_empty(items: DataFrame, pages: DataFrame, search: Sequence[str], page: str = "page_no",
                  counted: DataFrame | None = None, materialize: bool = True, from_one: bool = False) -> DataFrame:
    """Per search, keep the items of the pages before the first one with no counted items.
    With ``from_one`` pages are asked for as 1, 2, ..., and one that was not fetched stops too.

    ``pages`` lists every fetched page (search keys + page); ``counted`` is the
    item rows that make a page non-empty (default: ``items``).  The pages kept are found
    on the distinct (search, page) pairs alone, one row for each page, and the items
    join them on search and page, so a search with most of the items is spread
    over its pages.  The items feed both branches, so with ``materialize`` they are written once
    instead of being parsed out of their pages twice.
    """
    if materialize:
        items = materialize_df(items)
    counted = items if counted is None else counted
    rank = lambda d, name: d.withColumn(name, F.row_number().over(Window.partitionBy(*search).orderBy(page)))
    asked = pages.select(*search, page).distinct()
    asked = asked.where(F.col(page) >= 1).withColumn("_n", F.col(page)) if from_one else rank(asked, "_n")
    full = counted.select(*search, page).distinct().join(asked, [*search, page])
    good = rank(full, "_p").where(F.col("_p") == F.col("_n")).drop("_p", "_n")
    return items.join(good, [*search, page], "left_semi")


def dedup_pages_then_stop(items: DataFrame, pages: DataFrame, search: Sequence[str],
                          url: str = "url", page: str = "page_no", pos: str = "a_pos") -> DataFrame:
    """W1 then W4 as one outlet walks its result pages: a page is empty when it
    adds no unseen URL; later pages add nothing."""
    firsts = first_seen(items, [*search, url], [page, pos])
    return stop_at_empty(firsts, pages, search, page)
