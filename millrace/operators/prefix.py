"""Running sums without a task that sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP_BITS = 10  # places are summed within groups of 2**10 of them


def with_sum_before(rows: DataFrame, key: str, place: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over rows of the same key at smaller places.

    Whole groups of places are summed first, then the places within each group. ``rows`` is
    read twice, so it should be a written table; ``place`` is a unique number per key.
    """
    grouped = rows.withColumn("_group", F.shiftright(F.col(place).cast("bigint"), GROUP_BITS))
    earlier = lambda col, w: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = grouped.groupBy(key, "_group").agg(F.sum(value).alias("_sum"))
    offsets = totals.select(key, "_group", earlier("_sum", Window.partitionBy(key).orderBy("_group")).alias("_offset"))
    within = earlier(value, Window.partitionBy(key, "_group").orderBy(place))
    return grouped.join(offsets, [key, "_group"]).withColumn(name, F.col("_offset") + within).drop("_group", "_offset")
