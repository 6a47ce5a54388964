"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, mixture.

Every stage takes the documents that its predecessor kept, reread from Parquet, and all but the last return
the columns of ``documents``. ``run`` applies them to the documents table of a data folder. Each stage works on
empty tables, null and repeated rows, ties and texts of any length as its operator does; columns beside those of
``documents`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, mixing, near_dedup, substrings
from millrace.llm.queries import settle
from millrace.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts and such without a letter) go; a missing lang is filled in."""
    settle(spark)
    model = language.fit_languages(docs)
    found = language.predict_language(docs, model, list(COLUMNS))
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays: that of the smallest doc_id, a null one last, then of the smallest hash of its text.

    Rows are classed one by one, under a number that is written with them, so different texts of one doc_id are told apart, and so
    are texts without an id. Texts without words are in no class but their own and stay.
    """
    settle(spark)
    rows = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered-rows")
    classes = materialise(near_dedup.near_classes(rows.select(F.col("row").alias("doc_id"), "text")), "near-classes")
    keys = rows.select(F.col("row").alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "row").alias("key"))
    first = keys.join(classes, "doc_id").groupBy("class_id").agg(F.min("key").alias("key"))
    return rows.join(first.select(F.col("key.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier go. A text that loses none stays as it is; one that loses all goes."""
    settle(spark)
    return substrings.without_repeats(docs).where((F.col("text") != "") | F.col("text").isNull()).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    settle(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_leaks(docs, benchmark, list(COLUMNS))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time a document is taken, with its shard and place there."""
    settle(spark)
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("benchmark_leaks", drop_leaks),
    ("mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # languages, weighted samples and alignments have no SQL form
