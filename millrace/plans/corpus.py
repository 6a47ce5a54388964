"""Text corpus to token shards, and tokenizer training from a specification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import not_empty
from millrace.operators.bpe_codec import Tokenizer, choose_dtype
from millrace.operators.bpe_train import train_bpe, word_counts
from millrace.operators.cutoffs import limit_rows
from millrace.operators.quota import CorpusSpec, TokenizerSpec, mixed_corpus, quotas, validate_corpora
from millrace.operators.shards import ShardPlan, plan_shards
from millrace.session import materialise
from millrace.sinks.outputs import require_free
from millrace.sinks.token_shards import write_binary_shards, write_table_meta, write_token_table
from millrace.sources.paths import resolve_paths
from millrace.sources.readers import leading_files, parse_objects, read_lines, read_rows, read_table, read_text, string_field

PRETRAIN_SHARD_TOKENS = 100_000_000


def encode_documents(documents: DataFrame, tokenizer: Tokenizer, max_documents: int | None = None) -> DataFrame:
    """(ord, ids) of documents with tokens; any text that is not empty has some."""
    kept = documents.where(not_empty(F.col("text")))
    if max_documents is not None:
        kept = limit_rows(kept, max_documents)
    return kept.select("ord", tokenizer.encode(F.col("text")).alias("ids"))


def shard_tokens(tokens: DataFrame, limit: int) -> tuple[DataFrame, ShardPlan]:
    """Write (ord, ids[, labels]) once, plan shards on the lengths, and add ``shard_id``."""
    written = materialise(tokens, "tokens")
    plan = plan_shards(written.select("ord", F.size("ids").alias("n")), limit)
    return plan.attach(written), plan


def tokenise_corpus(
    documents: DataFrame,
    tokenizer: Tokenizer,
    path: str,
    shard_tokens_limit: int = PRETRAIN_SHARD_TOKENS,
    max_documents: int | None = None,
    dtype: str | None = None,
    binary: bool = False,
    overwrite: bool = False,
) -> DataFrame:
    """Encode, shard and write a corpus; returns the shard manifest."""
    dtype = choose_dtype(tokenizer.vocab_size, dtype)
    require_free(documents.sparkSession, path, overwrite)
    tokens, plan = shard_tokens(encode_documents(documents, tokenizer, max_documents), shard_tokens_limit)
    if binary:
        write_binary_shards(tokens, plan.manifest(), path, dtype, tokenizer.vocab_size, overwrite)
    else:
        write_token_table(tokens, path, overwrite)
        write_table_meta(documents.sparkSession, path, plan.manifest(), dtype, tokenizer.vocab_size)
    return plan.manifest().withColumn("dtype", F.lit(dtype))


def read_corpus(spark: SparkSession, corpus: CorpusSpec, wanted: int) -> DataFrame:
    """(source, ord, text) of one training source, enough of it to take ``wanted`` documents.

    Only empty text is dropped. JSON lines are taken in order, so leading files are read until
    they hold enough; a shuffled source is shuffled as a whole.
    """
    if corpus.kind == "local":
        rows = read_text(spark, corpus.path)
    elif corpus.kind == "jsonl":
        lines = lambda paths: parse_objects(read_lines(spark, paths)).select(
            "ord", string_field(F.col("row"), corpus.text_column).alias("text")
        )
        valid = lambda paths: lines(paths).where(not_empty(F.col("text"))).count()
        files = resolve_paths(spark, corpus.path)
        rows = lines(leading_files(files, wanted, valid))
    elif corpus.kind == "parquet":
        rows = read_rows(spark, corpus.path, [corpus.text_column]).withColumnRenamed(corpus.text_column, "text")
    else:
        rows = read_table(spark, corpus.table, corpus.split, columns=[corpus.text_column]).withColumnRenamed(corpus.text_column, "text")
    kept = rows if corpus.kind == "local" else rows.where(not_empty(F.col("text")))
    return kept.select(F.lit(corpus.name).alias("source"), "ord", "text")


def train_tokenizer(spark: SparkSession, spec: TokenizerSpec, overwrite: bool = False) -> Tokenizer:
    """Take each source's quota, count words, learn merges and save the tables."""
    validate_corpora(spec.corpora)
    require_free(spark, spec.path, overwrite)
    wanted = {r.source: r.n for r in quotas(spark, spec.corpora, spec.max_documents).collect()}  # one row per source
    documents = reduce(DataFrame.unionByName, [read_corpus(spark, c, wanted[c.name]) for c in spec.corpora])
    counts = materialise(word_counts(mixed_corpus(documents, spec)), "word-counts")
    tokenizer = Tokenizer(train_bpe(counts, spec.vocab_size))
    tokenizer.save(spark, spec.path, overwrite)
    return tokenizer
