"""Disk that shuffles hold."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of frames that nothing refers to any more: it does when the driver collects
    its garbage, which it may not do for long while the next files come in. The last query is still referred to
    until there is another."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
