"""Chat files to ChatML rows and to supervised token shards."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.bpe_codec import Tokenizer, choose_dtype
from millrace.operators.chat import (
    as_variant_rows,
    chat_limit,
    chat_summary,
    convert_chat,
    require_messages,
    supervise,
    supervised_count,
)
from millrace.operators.cutoffs import limit_rows
from millrace.operators.shards import dataset_manifest, plan_shards
from millrace.session import materialise
from millrace.sinks.outputs import require_free, write_chat_jsonl
from millrace.sinks.token_shards import write_binary_shards, write_table_meta, write_token_table
from millrace.sources.paths import write_file
from millrace.sources.readers import check_source, parse_objects, read_lines, read_rows, read_table

SUPERVISED_SHARD_TOKENS = 50_000_000


def read_chat(spark: SparkSession, kind: str, paths: str | Iterable[str] | None = None, table: str | None = None, split: str = "train") -> DataFrame:
    """(ord, row) from JSON lines, Parquet or a catalogue table."""
    if kind == "text":
        raise ValueError("unknown source kind: text")
    check_source(kind, paths, table)
    if kind == "jsonl":
        return parse_objects(read_lines(spark, paths))
    return as_variant_rows(read_rows(spark, paths) if kind == "parquet" else read_table(spark, table, split))


def convert_to_chatml(
    rows: DataFrame,
    path: str,
    source_name: str | None = None,
    table_name: str | None = None,
    max_examples: int | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Write ChatML rows and, as ``_summary.json`` among them, the summary; returns it (rows_seen, rows_written, rows_skipped)."""
    require_free(rows.sparkSession, path, overwrite)
    converted = chat_limit(materialise(convert_chat(rows, source_name, table_name), "chat"), max_examples)
    write_chat_jsonl(converted, path, overwrite)
    summary = chat_summary(converted)
    facts = summary.first().asDict() | {"source": source_name or table_name, "output": path}
    write_file(rows.sparkSession, f"{path}/_summary.json", json.dumps(facts, indent=2), overwrite=True)
    return summary


def tokenise_chat(
    rows: DataFrame,
    tokenizer: Tokenizer,
    path: str,
    shard_tokens_limit: int = SUPERVISED_SHARD_TOKENS,
    max_documents: int | None = None,
    binary: bool = False,
    overwrite: bool = False,
) -> DataFrame:
    """Encode converted rows (ord, row) with loss masks, shard and write; returns the totals."""
    require_free(rows.sparkSession, path, overwrite)
    tokens = materialise(supervise(require_messages(rows), tokenizer).select("ord", "ids", "labels"), "chat-tokens")
    if max_documents is not None:
        tokens = limit_rows(tokens, max_documents)
    plan = plan_shards(tokens.select("ord", F.size("ids").alias("n")), shard_tokens_limit)
    placed = plan.attach(tokens)
    if binary:
        write_binary_shards(placed, plan.manifest(), path, choose_dtype(tokenizer.vocab_size), tokenizer.vocab_size, overwrite)
    else:
        write_token_table(placed, path, overwrite)
        write_table_meta(rows.sparkSession, path, plan.manifest(), choose_dtype(tokenizer.vocab_size), tokenizer.vocab_size)
    supervised = tokens.agg(F.coalesce(F.sum(supervised_count(F.col("labels"))), F.lit(0)).alias("n")).first().n
    return dataset_manifest(plan.manifest()).withColumn("supervised_tokens", F.lit(supervised).cast("bigint"))
