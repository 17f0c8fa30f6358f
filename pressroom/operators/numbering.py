"""Contiguous row numbers in a global order, without a one-task window.

``row_number()`` over an unpartitioned window moves every row to one task.
Here the rows are range-partitioned on the order key, sorted inside each
partition and tagged with ``monotonically_increasing_id`` (partition index in
the high bits, position in the low 33 bits).  The tagged table is written to
the reliable checkpoint folder so the count pass and the numbering pass see
the same partitions (range bounds come from sampling and could differ on a
recomputation).  Per-partition counts -> prefix sums give each partition's
offset; that table has one row per partition, so its broadcast is bounded by
the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.session import materialize

_LOW = (1 << 33) - 1


def number_rows(df: DataFrame, order_cols: list, base=1, col: str = "row_num",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``col`` = base, base+1, ... following ``order_cols`` (must be a total order).

    ``base`` is an int, a scalar Column (e.g. ``store.agg(...).scalar()``), or a
    one-row DataFrame with a column ``base``.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = materialize(df.repartitionByRange(n, *keys)
                         .sortWithinPartitions(*keys)
                         .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    if isinstance(base, DataFrame):
        base = base.select("base").scalar()       # scalar subquery, evaluated inside this plan
    base_col = base if isinstance(base, Column) else F.lit(int(base))
    offsets = offsets.withColumn("_base", base_col.cast("long"))
    out = (tagged.join(F.broadcast(offsets), part == F.col("_part"))
           .withColumn(col, (F.col("_base") + F.col("_off")
                             + F.col("_mid").bitwiseAND(F.lit(_LOW))).cast("long")))
    return out.drop("_mid", "_part", "_off", "_base")
