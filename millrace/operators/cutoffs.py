"""First-n-per-source limits without sorting or shuffling whole sources.

A limit becomes one cut-off value per source: count rows per (source, bucket), find the one
bucket in which the n-th row lies, rank only that bucket, and then filter the full rows
with ``order <= cut``. A source that holds a third of all rows costs no more than others:
its rows are only counted, and the ranked bucket has a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import with_sum_before
from millrace.session import materialise

ORD_BUCKET_BITS = 20  # at most 2**20 rows of unique ``ord`` values in a bucket
HASH_BUCKET_DIGITS = 5  # about a millionth of the rows in a bucket of md5 keys


def ord_bucket(ord_col: Column) -> Column:
    return F.shiftright(ord_col, ORD_BUCKET_BITS)


def hash_bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, HASH_BUCKET_DIGITS), 16, 10).cast("bigint")


def bucket_counts(rows: DataFrame, key: str, order: str, bucket: Column) -> DataFrame:
    """(key, _bucket, _rows, _last, _before): one small row per source and bucket, from a written count."""
    slim = rows.select(key, F.col(order).alias("_at"), bucket.alias("_bucket"))
    counts = slim.groupBy(key, "_bucket").agg(F.count("*").alias("_rows"), F.max("_at").alias("_last"))
    return with_sum_before(materialise(counts, "bucket-counts"), key, "_bucket", "_rows", "_before")


def cuts(rows: DataFrame, key: str, order: str, bucket: Column, wanted: DataFrame) -> DataFrame:
    """(key, n, cut, taken), written: ``cut`` is the order value of the ``n``-th row of each key.

    ``wanted`` is (key, n), maybe with several n for a key. A key with fewer rows is cut at
    its last row; n < 1 or a key without rows gives no row. The result is as small as
    ``wanted``, one row for each source of a specification, so it is broadcast to the rows.
    """
    counts = bucket_counts(rows, key, order, bucket)
    edges = counts.join(wanted.select(key, "n"), key).where(F.col("_before") < F.col("n"))
    reach = F.col("_before") + F.col("_rows")
    full = edges.where(reach <= F.col("n")).groupBy(key, "n").agg(F.max("_last").alias("cut"), F.max(reach).alias("taken"))
    split = materialise(edges.where(reach > F.col("n")).select(key, "_bucket", "_before", "n"), "split-buckets")
    slim = rows.select(key, F.col(order).alias("_at"), bucket.alias("_bucket"))
    rank = F.row_number().over(Window.partitionBy(key, "n").orderBy("_at"))
    partial = (
        slim.join(F.broadcast(split), [key, "_bucket"])
        .withColumn("taken", rank + F.col("_before"))
        .where(F.col("taken") == F.col("n"))
        .select(key, "n", F.col("_at").alias("cut"), "taken")
    )
    both = full.unionByName(partial).groupBy(key, "n").agg(F.max("cut").alias("cut"), F.max("taken").alias("taken"))
    return materialise(both, "cuts")


def take_first(rows: DataFrame, key: str, order: str, bucket: Column, wanted: DataFrame) -> DataFrame:
    """The first ``n`` rows of every key in ``order``; keys not in ``wanted`` are dropped."""
    found = cuts(rows, key, order, bucket, wanted).select(key, "cut")
    return rows.join(F.broadcast(found), key).where(F.col(order) <= F.col("cut")).drop("cut")


def take_between(rows: DataFrame, key: str, order: str, bucket: Column, wanted: DataFrame) -> DataFrame:
    """Rows ``skip`` + 1 to ``n`` of every key; ``wanted`` is (key, skip, n)."""
    ends = wanted.select(key, "n").union(wanted.select(key, F.col("skip").alias("n"))).distinct()
    found = cuts(rows, key, order, bucket, ends).select(key, "n", "cut")
    low = found.select(key, F.col("n").alias("skip"), F.col("cut").alias("_low"))
    high = found.withColumnRenamed("cut", "_high")
    span = materialise(wanted.join(high, [key, "n"]).join(low, [key, "skip"], "left").select(key, "_low", "_high"), "spans")
    inside = (F.col(order) <= F.col("_high")) & (F.col("_low").isNull() | (F.col(order) > F.col("_low")))
    return rows.join(F.broadcast(span), key).where(inside).drop("_low", "_high")


def limit_rows(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first ``max(1, n)`` rows of the whole frame: the limit is tested after a row is added."""
    spark = rows.sparkSession
    wanted = spark.range(1).select(F.lit(0).alias("_all"), F.lit(max(1, n)).cast("bigint").alias("n"))
    keyed = rows.withColumn("_all", F.lit(0))
    cut = cuts(keyed, "_all", order, ord_bucket(F.col(order)), wanted).first()
    # One value, so it can be a literal that the scan filters by.
    return rows.where(F.col(order) <= cut["cut"]) if cut is not None else rows.where(F.lit(False))
