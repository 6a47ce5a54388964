"""Exact places of rows in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 … in ``order``, which has to tell all rows apart, so that no task gets all rows of a tie.

    Rows are sorted in ranges, one for each task, and numbered within; the counts of the ranges are summed up besides.
    """
    at = F.monotonically_increasing_id()  # the task's number, then the row's in the task
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(part).agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))  # a row for each task
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + row + 1).drop("_part", "_at", "_before")
