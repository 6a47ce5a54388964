"""What a task holds and moves does not grow with its input."""

import shutil

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import windows
from millrace.operators.windows import token_blocks
from millrace.plans import catalog
from millrace.plans.training import open_datasets
from millrace.session import apply_settings
from millrace.sinks.token_shards import read_binary_blocks, read_shard_metas, write_binary_shards, write_table_meta, write_token_table


def test_batches_of_texts_are_bounded_by_bytes(spark):
    rows = apply_settings(spark).range(0, 4000, 1, 1).select(F.repeat(F.lit("some text "), 1000).alias("text"))  # 40 MB in one task

    @F.arrow_udf("bigint")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    assert rows.select(held("text").alias("n")).agg(F.max("n")).first()[0] < 8 << 20


def test_blocks_move_tokens_once_and_gather_no_lists(spark):
    rows = spark.range(300).select(
        F.lit("s").alias("source"), F.lit(0).alias("shard_id"), (F.col("id") * 50).alias("tok_start"),
        F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (F.col("id") * 50 + i).cast("int")).alias("ids"),
    )
    blocks = token_blocks(rows, 64, 10)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1
    found = {r.block_id: r.ids for r in blocks.collect()}
    assert found == {b: list(range(b * 64, min(15_000, b * 64 + 74))) for b in range(235)}


def test_blocks_across_spans_and_batches(spark, monkeypatch):
    monkeypatch.setattr(windows, "SPAN_TOKENS", 128)
    rows = spark.range(300).select(
        F.lit("s").alias("source"), (F.col("id") % 2).cast("int").alias("shard_id"), (F.floor(F.col("id") / 2) * 50).alias("tok_start"),
        F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (F.floor(F.col("id") / 2) * 50 + i).cast("int")).alias("ids"),
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = {(r.shard_id, r.block_id): r.ids for r in token_blocks(rows, 64, 100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {(s, b): list(range(b * 64, min(7500, b * 64 + 164))) for s in (0, 1) for b in range(118)}


def test_a_manifest_lists_no_shard_folders(spark, tmp_path):
    coded = spark.range(40).select(F.col("id").alias("ord"), F.array(F.lit(1), F.lit(2)).alias("ids"), F.col("id").cast("int").alias("shard_id"))
    path = str(tmp_path / "t")
    write_token_table(coded, path)
    write_table_meta(spark, path, spark.range(40).selectExpr("int(id) shard_id", "2L num_tokens", "1L num_docs"), "uint16", 300)
    for shard in range(40):  # data that is gone is noticed where tokens are read and not before
        shutil.rmtree(f"{path}/shard_id={shard}")
    manifest, _ = open_datasets(spark, {"t": path})
    assert manifest.count() == 40


def test_metas_are_read_once(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("ord"), F.array(F.lit(1), F.lit(2)).alias("ids"), F.col("id").cast("int").alias("shard_id"))
    path = str(tmp_path / "b")
    write_binary_shards(rows, spark.range(60).selectExpr("int(id) shard_id", "2L num_tokens"), path, "uint16", 300)
    metas = read_shard_metas(spark, path)
    for file in (tmp_path / "b").glob("*.meta.json"):
        file.unlink()
    assert [(r.shard_id, r.num_tokens) for r in metas.orderBy("shard_id").collect()] == [(i, 2) for i in range(60)]


def test_files_of_a_resumed_copy_grow_in_number(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 20).alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "COPY_BYTES", 4000)
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, label: str(tmp_path / "copy"))
    assert catalog.parquet_resume(spark, str(tmp_path)).count() == 400 - 400 // 3
    assert len(list((tmp_path / "copy").glob("part-*.parquet"))) == 10


def test_blocks_of_many_shards_are_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("ord"), F.array(F.lit(1), F.lit(2)).alias("ids"), F.col("id").cast("int").alias("shard_id"))
    path = str(tmp_path / "b")
    write_binary_shards(rows, spark.range(200).selectExpr("int(id) shard_id", "2L num_tokens"), path, "uint16", 300)
    blocks = read_binary_blocks(read_shard_metas(spark, path), "s", 8)
    assert blocks.select(F.spark_partition_id().alias("p")).distinct().count() > 1
