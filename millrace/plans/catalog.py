"""Every operator as a query over the standard tables of a data directory."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import format_count, parse_count
from millrace.functions.text import not_blank, not_empty, strip, words
from millrace.operators import chat, samples
from millrace.operators.bpe_codec import Tokenizer, choose_dtype
from millrace.operators.bpe_train import pair_counts, train_bpe, word_counts, word_symbols
from millrace.operators.char_codec import CharTokenizer, char_vocab
from millrace.operators.cutoffs import limit_rows, ord_bucket, take_first
from millrace.operators.quota import CorpusSpec, TokenizerSpec, mixed_corpus
from millrace.operators.shards import ShardPlan, dataset_manifest, plan_shards
from millrace.operators.windows import (
    MixtureSource,
    batches,
    mixture_report,
    pretrain_windows,
    source_draws,
    supervised_windows,
    token_accounting,
    token_blocks,
    usable_shards,
    window_plan,
)
from millrace.plans.chat import read_chat
from millrace.plans.corpus import encode_documents
from millrace.plans.specs import load_run_spec
from millrace.plans.training import open_datasets
from millrace.session import apply_settings, materialise, scratch_path
from millrace.sinks.outputs import write_chat_jsonl, write_sample_jsonl
from millrace.sinks.token_shards import (
    read_binary_blocks,
    read_shard_metas,
    read_token_table,
    write_binary_shards,
    write_table_meta,
    write_token_table,
)
from millrace.sources.paths import write_file
from millrace.sources.readers import (
    FILE_SHIFT, parse_objects, read_documents, read_lines, read_rows, read_rows_after, read_table, spread, string_field,
)
from millrace.streaming.draws import stream_draws, write_draws
from millrace.streaming.ingest import append_to, convert_stream, encode_stream, stream_lines, stream_parquet

# Parameters of the registered queries; the oracles use the same values.
MERGES = 32
SHARD_TOKENS = 50_000
CHAT_SHARD_TOKENS = 8_000
SEQ_LEN = 64
CHAT_SEQ_LEN = 16
BLOCK = 256
BATCH = 8
ACCUMULATE = 2
WORKERS = 2
COPY_BYTES = 128 << 20  # of text in a file of a copy
SEED = 42
MIXTURE = [("en", 0.55), ("fr", 0.25), ("de", 0.15), ("es", 0.05)]
CORPORA = [(f"src{i}", ("jsonl", "parquet", "local")[i % 3], float(i % 4 + 1)) for i in range(20)]

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, label: str, make: Callable[[], object]) -> object:
    """Intermediate results that several queries share, made once per application."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text) for costly per-document work."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text", "lang", "source")
    return spread(docs, "ord")


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


# --- filters and words


def doc_filter(spark, sf):
    docs = table(spark, sf, "documents").where(not_blank(F.col("text")))
    return docs.select("doc_id", "lang", F.length("text").cast("bigint").alias("chars"))


def train_filter(spark, sf):
    pages = table(spark, sf, "pages").where(not_empty(F.col("html")))
    return pages.select("page_id", F.length("html").cast("bigint").alias("chars"))


def parquet_positions(spark, sf):
    docs = read_rows(spark, f"{sf}/documents.parquet", ["doc_id", "text"]).where(not_blank(F.col("text")))
    return docs.select("ord", "doc_id")


def pretok_word_counts(spark, sf):
    return word_counts(texts(spark, sf))


def pretok_doc_counts(spark, sf):
    return texts(spark, sf).select("doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))


# --- vocabulary


def bpe_pair_counts(spark, sf):
    pairs = pair_counts(word_symbols(materialise(word_counts(texts(spark, sf)), "word-counts")))
    return pairs.select(F.col("l").cast("bigint").alias("l"), F.col("r").cast("bigint").alias("r"), "cnt")


def _train(spark, sf) -> Tokenizer:
    counts = materialise(word_counts(texts(spark, sf)), "word-counts")
    return Tokenizer(train_bpe(counts, 257 + MERGES))


def tokenizer(spark, sf) -> Tokenizer:
    return _once(spark, sf, "tokenizer", lambda: _train(spark, sf))


def bpe_train(spark, sf):
    trained = _train(spark, sf)
    _made[(spark.sparkContext.applicationId, sf, "tokenizer")] = trained
    merges = trained.merge_table(spark)
    return merges.select(*[F.col(c).cast("bigint").alias(c) for c in merges.columns])


def bpe_vocab(spark, sf):
    vocab = tokenizer(spark, sf).vocabulary_table(spark)
    return vocab.select(F.col("id").cast("bigint").alias("id"), "token")


def bpe_encode(spark, sf):
    ids = tokenizer(spark, sf).encode(F.col("text"))
    return texts(spark, sf).select("doc_id", joined(ids).alias("ids"))


def bpe_encode_counts(spark, sf):
    ids = tokenizer(spark, sf).encode(F.col("text"))
    return texts(spark, sf).select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"))


def bpe_decode(spark, sf):
    coder = tokenizer(spark, sf)
    return texts(spark, sf).select("doc_id", coder.decode(coder.encode(F.col("text"))).alias("text"))


def char_vocabulary(spark, sf):
    vocab = char_vocab(texts(spark, sf))
    return vocab.select("ch", F.col("id").cast("bigint").alias("id"))


def _char_tokenizer(spark, sf) -> CharTokenizer:
    return _once(spark, sf, "chars", lambda: CharTokenizer.of(texts(spark, sf)))


def char_encode(spark, sf):
    ids = _char_tokenizer(spark, sf).encode(F.col("text"))
    return texts(spark, sf).select("doc_id", joined(ids).alias("ids"))


def char_decode(spark, sf):
    coder = _char_tokenizer(spark, sf)
    return texts(spark, sf).select("doc_id", coder.decode(coder.encode(F.col("text"))).alias("text"))


# --- shards


def tokens(spark, sf) -> DataFrame:
    """(ord, source, ids, n) of the corpus, written once; the language stands for the source, ``n`` is the number of ids."""

    def make() -> DataFrame:
        docs = documents(spark, sf).where(not_empty(F.col("text")))
        ids = tokenizer(spark, sf).encode(F.col("text"))
        coded = docs.select("ord", F.col("lang").alias("source"), ids.alias("ids"))
        return materialise(coded.withColumn("n", F.size("ids")), "tokens")

    return _once(spark, sf, "tokens", make)


def shard_plan(spark, sf) -> ShardPlan:
    lengths = tokens(spark, sf).select("ord", "n")
    return _once(spark, sf, "plan", lambda: plan_shards(lengths, SHARD_TOKENS))


def _manifest_columns(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        F.col("shard_id").cast("bigint").alias("shard_id"), F.col("first_ord").alias("first_doc"), "num_docs", "num_tokens"
    )


def shard_manifest(spark, sf):
    docs = encode_documents(documents(spark, sf), tokenizer(spark, sf))
    return _manifest_columns(plan_shards(docs.select("ord", F.size("ids").alias("n")), SHARD_TOKENS).manifest())


def shard_manifest_small(spark, sf):
    """The same plan with small chunks, so that shards run across many of them."""
    lengths = tokens(spark, sf).select("ord", "n")
    return _manifest_columns(plan_shards(lengths, SHARD_TOKENS, chunk_docs=128).manifest())


def doc_offsets(spark, sf):
    placed = shard_plan(spark, sf).documents()
    return placed.select(F.col("ord").alias("doc_id"), F.col("shard_id").cast("bigint").alias("shard_id"), "tok_start", "tok_end")


def shard_of_document(spark, sf):
    placed = shard_plan(spark, sf).attach(tokens(spark, sf))
    return placed.select(F.col("ord").alias("doc_id"), F.col("shard_id").cast("bigint").alias("shard_id"))


def dataset_totals(spark, sf):
    return dataset_manifest(shard_plan(spark, sf).manifest(), choose_dtype(tokenizer(spark, sf).vocab_size))


def first_documents(spark, sf):
    docs = documents(spark, sf).where(not_blank(F.col("text")))
    n = docs.count() // 3
    return limit_rows(docs.select("ord", "source"), n).select(F.col("ord").alias("doc_id"), "source")


def corpus_blocks(spark, sf):
    offsets = shard_plan(spark, sf).documents().select("ord", "shard_id", "tok_start")
    placed = tokens(spark, sf).join(offsets, "ord").withColumn("source", F.lit("all"))
    return _block_columns(token_blocks(placed, BLOCK))


def _block_columns(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("shard_id").cast("bigint").alias("shard_id"), "block_id", joined(F.col("ids")).alias("ids"))


def binary_shards(spark, sf):
    path = scratch_path(spark, "binary")
    vocab_size = tokenizer(spark, sf).vocab_size
    plan = shard_plan(spark, sf)
    write_binary_shards(plan.attach(tokens(spark, sf)), plan.manifest(), path, choose_dtype(vocab_size), vocab_size)
    return _block_columns(read_binary_blocks(read_shard_metas(spark, path), "all", BLOCK))


# --- chat


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


def chat_json(spark, sf) -> DataFrame:
    """(ord, row): every conversation as a JSON object in one of six schemas."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    grouped = turns(spark, sf).groupBy(F.col("conv_id").alias("ord")).agg(ordered.alias("t"))
    first = lambda role: F.get(F.filter("t", lambda t: t["role"] == role), F.lit(0))["text"]
    plain = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    alias = lambda t: F.concat(F.lit(" "), F.when(t["role"] == "user", "Human").when(t["role"] == "assistant", "GPT").otherwise("System"), F.lit("\t"))
    aliased = F.transform("t", lambda t: F.struct(F.lit("").alias("role"), alias(t).alias("from"), t["text"].alias("value")))
    parts = F.transform(
        "t",
        lambda t: F.struct(
            t["role"].alias("role"),
            F.transform(F.split(t["text"], "\n"), lambda s: F.struct(F.lit("text").alias("type"), s.alias("text"))).alias("content"),
        ),
    )
    broken = F.array(F.struct(F.lit("tool").alias("role"), F.lit("x").alias("content")))
    shape = F.pmod("ord", F.lit(6))
    body = (
        F.when(shape == 0, F.to_json(F.struct(plain.alias("messages"), F.col("ord").alias("prompt_id"))))
        .when(shape == 1, F.to_json(F.struct(aliased.alias("conversations"), F.lit("chat").alias("dataset"))))
        .when(shape == 2, F.to_json(F.struct(parts.alias("conversation"), F.lit("web").alias("source"))))
        .when(shape == 3, F.to_json(F.struct(broken.alias("messages"), plain.alias("conversations"))))
        .when(shape == 4, F.to_json(F.struct(F.lit("  ").alias("prompt"), first("user").alias("question"), first("assistant").alias("answer"), first("system").alias("input"))))
        .otherwise(F.to_json(F.struct(first("user").alias("instruction"), first("assistant").alias("output"), F.lit("qa").alias("category"))))
    )
    return grouped.select("ord", F.parse_json(body).alias("row"))


def _converted(spark, sf) -> DataFrame:
    return _once(spark, sf, "chat", lambda: materialise(chat.convert_chat(chat_json(spark, sf)), "chat"))


def _chat_columns(converted: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return converted.select(F.col("ord").alias("conv_id"), "text", "dataset", text("source"), text("prompt_id"), text("category"))


def chat_convert(spark, sf):
    return _chat_columns(chat.convert_chat(chat_json(spark, sf)).where("text IS NOT NULL"))


def chat_totals(spark, sf):
    return chat.chat_summary(_converted(spark, sf))


def chat_limited(spark, sf):
    converted = _converted(spark, sf)
    return chat.chat_summary(chat.chat_limit(converted, converted.where("text IS NOT NULL").count() // 2))


def chatml_render(spark, sf):
    conversations = chat.conversation_messages(turns(spark, sf))
    return conversations.select(F.col("ord").alias("conv_id"), chat.render(F.col("messages")).alias("text"))


def role_map(spark, sf):
    raw = F.concat(F.lit("　 "), F.when(F.col("role") == "user", "PROMPTER").when(F.col("role") == "assistant", "Bot").otherwise(F.col("role")), F.lit("\n"))
    return turns(spark, sf).select("conv_id", "turn", chat.normalise_role(raw).alias("role"))


def content_parts(spark, sf):
    raw = F.parse_json(F.to_json(F.split("text", "[,.]")))
    return turns(spark, sf).select("conv_id", "turn", chat.content_text(raw).alias("content"))


def prompt_response(spark, sf):
    fields = F.map_from_arrays(F.array(F.lit("query"), F.lit("completion"), F.lit("input")), F.array("text", "role", F.lit(" more ")))
    rows = turns(spark, sf).select("conv_id", "turn", F.parse_json(F.to_json(fields)).alias("row"))
    pair = chat.extract_messages(F.col("row"))
    return rows.select("conv_id", "turn", pair[0]["content"].alias("prompt"), pair[1]["content"].alias("response"))


def chat_tokens(spark, sf) -> DataFrame:
    def make() -> DataFrame:
        coded = chat.supervise(chat.conversation_messages(turns(spark, sf)), tokenizer(spark, sf))
        return materialise(coded.select("ord", F.lit("chat").alias("source"), "ids", "labels"), "chat-tokens")

    return _once(spark, sf, "chat-tokens", make)


def sft_labels(spark, sf):
    coded = chat.supervise(chat.conversation_messages(turns(spark, sf)), tokenizer(spark, sf))
    return coded.select(F.col("ord").alias("conv_id"), joined(F.col("ids")).alias("ids"), joined(F.col("labels")).alias("labels"))


def chat_plan(spark, sf) -> ShardPlan:
    lengths = chat_tokens(spark, sf).select("ord", F.size("ids").alias("n"))
    return _once(spark, sf, "chat-plan", lambda: plan_shards(lengths, CHAT_SHARD_TOKENS))


def sft_totals(spark, sf):
    placed = chat_plan(spark, sf).attach(chat_tokens(spark, sf))
    return placed.groupBy(F.col("shard_id").cast("bigint").alias("shard_id")).agg(
        F.count("*").alias("num_docs"),
        F.sum(F.size("ids")).alias("num_tokens"),
        F.sum(chat.supervised_count(F.col("labels"))).alias("supervised_tokens"),
    )


# --- quotas, draws and windows


def corpus_take(spark, sf):
    docs = documents(spark, sf).where(not_empty(F.col("text")))
    corpora = [CorpusSpec(name, kind, weight, path="-") for name, kind, weight in CORPORA]
    spec = TokenizerSpec(corpora, "-", max_documents=docs.count() // 2, seed=SEED)
    taken = mixed_corpus(docs.select("source", "ord", "text"), spec)
    return taken.select(F.col("src_ord").cast("bigint").alias("src_ord"), "source", F.col("ord").alias("doc_id"), "place")


def mixture_sources() -> list[MixtureSource]:
    return [MixtureSource(name, weight) for name, weight in MIXTURE]


def mixture(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """(manifest, blocks, windows to draw): each language sharded as a source of its own."""

    def make():
        placed, manifests = [], []
        for name, _ in MIXTURE:
            rows = tokens(spark, sf).where(F.col("source") == name)
            plan = plan_shards(rows.select("ord", "n"), SHARD_TOKENS)
            rows = rows.drop("n")
            placed.append(rows.join(plan.documents().select("ord", "shard_id", "tok_start"), "ord"))
            manifests.append(plan.manifest().withColumn("source", F.lit(name)))
        return _as_dataset(manifests, placed, SEQ_LEN)

    return _once(spark, sf, "mixture", make)


def _as_dataset(manifests: list[DataFrame], placed: list[DataFrame], seq_len: int) -> tuple[DataFrame, DataFrame, int]:
    manifest = materialise(samples.mix(manifests).drop("src_ord"), "manifest")
    blocks = materialise(token_blocks(samples.mix(placed), BLOCK, seq_len), "blocks")
    total = manifest.agg(F.sum("num_tokens").alias("n")).first().n
    return manifest, blocks, total // (seq_len * WORKERS)


def chat_dataset(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    def make():
        plan = chat_plan(spark, sf)
        placed = chat_tokens(spark, sf).join(plan.documents().select("ord", "shard_id", "tok_start"), "ord")
        return _as_dataset([plan.manifest().withColumn("source", F.lit("chat"))], [placed], CHAT_SEQ_LEN)

    return _once(spark, sf, "chat-dataset", make)


def mixture_draws(spark, sf):
    _, _, n = mixture(spark, sf)
    draws = source_draws(spark, mixture_sources(), n, SEED, WORKERS)
    return draws.select(F.col("worker").cast("bigint").alias("worker"), "draw", "source")


def mixture_stream(spark, sf):
    """The draws once more, as a stream that is stopped after each half."""
    _, _, n = mixture(spark, sf)
    path, checkpoint = scratch_path(spark, "draws"), scratch_path(spark, "draws-checkpoint")
    for _ in range(2):
        write_draws(stream_draws(spark, mixture_sources(), n // 2, SEED, WORKERS), lambda draws: draws, path, checkpoint).awaitTermination()
    return spark.read.parquet(f"{path}/batch-*").select(F.col("worker").cast("bigint").alias("worker"), "draw", "source")


def _plan_columns(plan: DataFrame, *more: Column) -> DataFrame:
    return plan.select(
        F.col("worker").cast("bigint").alias("worker"), "draw", "source", F.col("shard_id").cast("bigint").alias("shard_id"), "start", *more
    )


def window_starts(spark, sf):
    manifest, _, n = mixture(spark, sf)
    draws = source_draws(spark, mixture_sources(), n, SEED, WORKERS).withColumn("attempt", F.lit(0))
    return _plan_columns(window_plan(draws, usable_shards(manifest, SEQ_LEN, [s for s, _ in MIXTURE]), SEQ_LEN))


def _pretrain(spark, sf) -> DataFrame:
    manifest, blocks, n = mixture(spark, sf)
    draws = source_draws(spark, mixture_sources(), n, SEED, WORKERS)
    return pretrain_windows(draws, manifest, blocks, [s for s, _ in MIXTURE], SEQ_LEN, BLOCK)


def stored_mixture(spark, sf) -> dict[str, str]:
    """Paths of a token table for each language, written once."""

    def make():
        paths, vocab_size = {}, tokenizer(spark, sf).vocab_size
        for name, _ in MIXTURE:
            rows = tokens(spark, sf).where(F.col("source") == name).drop("source")
            plan, paths[name] = plan_shards(rows.select("ord", "n"), SHARD_TOKENS), scratch_path(spark, f"table-{name}")
            write_token_table(plan.attach(rows.drop("n")), paths[name])
            write_table_meta(spark, paths[name], plan.manifest(), choose_dtype(vocab_size), vocab_size)
        return paths

    return _once(spark, sf, "stored-mixture", make)


def windows_pretrain(spark, sf):
    """Windows of the stored token tables, of which only the row groups of planned windows are read."""
    manifest, fetch = open_datasets(spark, stored_mixture(spark, sf))
    total = manifest.agg(F.sum("num_tokens").alias("n")).first().n
    draws = source_draws(spark, mixture_sources(), total // (SEQ_LEN * WORKERS), SEED, WORKERS)
    found = pretrain_windows(draws, manifest, fetch, [s for s, _ in MIXTURE], SEQ_LEN, BLOCK)
    return _plan_columns(found, joined(F.col("x")).alias("x"), joined(F.col("y")).alias("y"))


def windows_sft(spark, sf):
    manifest, blocks, n = chat_dataset(spark, sf)
    draws = source_draws(spark, [MixtureSource("chat")], n, SEED, WORKERS)
    found = supervised_windows(draws, manifest, blocks, ["chat"], CHAT_SEQ_LEN, BLOCK)
    return _plan_columns(found, F.col("attempt").cast("bigint").alias("attempt"), joined(F.col("x")).alias("x"), joined(F.col("y")).alias("y"))


def windows_ranges(spark, sf):
    """The supervised windows again, from binary shards of which only the windows' bytes are read."""
    path = scratch_path(spark, "labelled")
    _, _, n = chat_dataset(spark, sf)
    plan, vocab_size = chat_plan(spark, sf), tokenizer(spark, sf).vocab_size
    write_binary_shards(plan.attach(chat_tokens(spark, sf)), plan.manifest(), path, choose_dtype(vocab_size), vocab_size)
    manifest, fetch = open_datasets(spark, {"chat": path})
    draws = source_draws(spark, [MixtureSource("chat")], n, SEED, WORKERS)
    found = supervised_windows(draws, manifest, fetch, ["chat"], CHAT_SEQ_LEN, BLOCK)
    return _plan_columns(found, F.col("attempt").cast("bigint").alias("attempt"), joined(F.col("x")).alias("x"), joined(F.col("y")).alias("y"))


def window_batches(spark, sf):
    windows = batches(_pretrain(spark, sf), BATCH, ACCUMULATE)
    per = windows.groupBy(F.col("worker").cast("bigint").alias("worker"), "step", "batch_id")
    return per.agg(F.count("*").alias("windows"), F.min("draw").alias("first_draw"))


def step_tokens(spark, sf):
    steps = token_accounting(_pretrain(spark, sf), BATCH, SEQ_LEN, ACCUMULATE)
    return steps.withColumn("worker", F.col("worker").cast("bigint"))


def source_report(spark, sf):
    manifest, _, _ = mixture(spark, sf)
    report = mixture_report(manifest, mixture_sources())
    return report.withColumn("num_tokens", F.col("num_tokens").cast("bigint")).withColumn("num_docs", F.col("num_docs").cast("bigint"))


# --- samples


def sample_rows(spark, sf) -> DataFrame:
    """(ord, row): documents as JSON objects whose source is sometimes empty or only in the metadata."""
    body = F.to_json(F.struct(
        "text",
        F.when(F.col("lang") == "fr", "").when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("source")).alias("source"),
        F.struct(F.col("source"), F.col("ord").alias("doc_id")).alias("metadata"),
    ))
    return documents(spark, sf).select("ord", "lang", F.parse_json(body).alias("row"))


def normalise_rows(spark, sf):
    rows = samples.normalise_json(sample_rows(spark, sf), "sample")
    return rows.select(F.col("ord").alias("doc_id"), "text", "dataset", F.col("source").cast("string").alias("source"))


def _top_up(spark, sf) -> tuple[DataFrame, int]:
    """An existing sample of an eighth of the documents per language, lifted to a quarter."""

    def make():
        available = documents(spark, sf).where(not_blank(F.col("text"))).select("ord", F.col("lang").alias("dataset"))
        total = available.count()
        had = available.select("dataset").distinct().withColumn("n", F.lit(total // 8).cast("bigint"))
        existing = materialise(take_first(available, "dataset", "ord", ord_bucket(F.col("ord")), had), "sample")
        existing = existing.withColumn("added", F.lit(False))
        rows = samples.top_up(available.withColumn("added", F.lit(True)), existing, total // 4)
        return materialise(rows.select("ord", "dataset", "added"), "sample"), total // 4

    return _once(spark, sf, "top-up", make)


def resume_topup(spark, sf):
    rows, _ = _top_up(spark, sf)
    return rows.select(F.col("ord").alias("doc_id"), "dataset", "added")


def mixed_rebuild(spark, sf):
    rows, _ = _top_up(spark, sf)
    names = [name for name, _ in MIXTURE]
    mixed = samples.mix([rows.where(F.col("dataset") == n) for n in [*names, names[0]]])
    return mixed.select(F.col("src_ord").cast("bigint").alias("src_ord"), F.col("ord").alias("doc_id"))


def sample_totals(spark, sf):
    rows, target = _top_up(spark, sf)
    summary = samples.sample_summary(rows, target)
    older = summary.select(F.lit("pretrain").alias("section"), "name", F.lit(0).cast("bigint").alias("rows"), "target")
    other = summary.select(F.lit("chat").alias("section"), "name", "rows", "target")
    return samples.replace_section(older.unionByName(other), "pretrain", summary)


def seed_choice(spark, sf):
    sizes = table(spark, sf, "documents").groupBy(F.col("lang").alias("name"), F.col("source").alias("path")).agg(F.count("*").alias("rows"))
    target = sizes.agg(F.max("rows")).first()[0]
    return samples.pick_seed(sizes, target)


def counts_format(spark, sf):
    sums = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    rounded = F.col("chars") - F.col("chars") % 1000
    label = format_count(rounded)
    return sums.select("source", label.alias("label"), format_count(F.col("chars")).alias("plain"), parse_count(label).alias("parsed"))


def jsonl_documents(spark, sf):
    """Write normalised JSON lines, read them back and take text and number from each row."""
    path = scratch_path(spark, "jsonl")
    write_sample_jsonl(samples.normalise_json(sample_rows(spark, sf), "sample"), path)
    rows = parse_objects(read_lines(spark, path))
    number = F.try_variant_get("row", "$.metadata.doc_id", "bigint")
    return rows.select(number.alias("doc_id"), string_field(F.col("row"), "text").alias("text"), string_field(F.col("row"), "dataset").alias("dataset"))


def parquet_resume(spark, sf):
    """The documents after the first third, from a copy in many row groups, of which the first ones are not opened."""
    path = scratch_path(spark, "groups")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    files = max(4, -(-(size.bytes or 0) // COPY_BYTES))
    docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 1 << 17).parquet(path)
    rows = read_rows_after(spark, path, size.rows // 3, ["doc_id", "text", "absent"])
    ranked = rows.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.col("absent").isNull().alias("absent"))
    return ranked


def jsonl_limited(spark, sf):
    """The first third of a JSON-lines corpus, with other file splits for the rows than for the limit."""
    path = scratch_path(spark, "jsonl")
    write_sample_jsonl(samples.normalise_json(sample_rows(spark, sf), "sample"), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        rows = read_documents(spark, "jsonl", path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        limited = limit_rows(rows, rows.count() // 3)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
        return materialise(limited.select("text"), "limited")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def token_table(spark, sf):
    """Write the token table with its facts and read places and shards back from it."""
    path = scratch_path(spark, "token-table")
    plan, vocab_size = shard_plan(spark, sf), tokenizer(spark, sf).vocab_size
    write_token_table(plan.attach(tokens(spark, sf).drop("n")), path)
    write_table_meta(spark, path, plan.manifest(), choose_dtype(vocab_size), vocab_size)
    _, stored = read_token_table(spark, path)
    return stored.select(F.col("ord").alias("doc_id"), F.col("shard_id").cast("bigint").alias("shard_id"), "tok_start", F.size("ids").cast("bigint").alias("n_tokens"))


def chatml_file(spark, sf):
    """Write converted chats as JSON lines and render the messages read back."""
    path = scratch_path(spark, "chatml")
    write_chat_jsonl(_converted(spark, sf), path)
    return chat.require_messages(read_chat(spark, "jsonl", path)).select(chat.render(F.col("messages")).alias("text"))


def blank_rows(spark, sf):
    """What the filters keep where blank and padded texts are put among the documents."""
    blank = F.concat(F.lit(" \t\n"), F.lit("\u3000"))
    kind = F.pmod("doc_id", F.lit(4))
    text = F.when(kind == 0, "").when(kind == 1, blank).when(kind == 2, F.concat(blank, "text")).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", not_blank(F.col("text")).alias("not_blank"), not_empty(F.col("text")).alias("not_empty"), strip(F.col("text")).alias("stripped"))


def stream_encode(spark, sf):
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    schema = "doc_id bigint, text string"
    coded = encode_stream(spread(stream_parquet(spark, f"{sf}/documents*.parquet", schema), "doc_id"), tokenizer(spark, sf), "doc_id")
    append_to(coded, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))


def stream_chat(spark, sf):
    """The chat file once more, taken up in two runs of a stream, as it grows."""
    folder, path, checkpoint = (scratch_path(spark, f"chat-{n}") for n in ("lines", "stream", "checkpoint"))
    rows = chat_json(spark, sf).select(F.col("ord"), F.to_json("row").alias("line"))
    for part in range(2):
        rows.where(F.pmod("ord", F.lit(2)) == part).select("line").write.mode("append").text(folder)
        convert_stream(stream_lines(spark, folder, files_per_batch=2), path, checkpoint).awaitTermination()
    stored = read_lines(spark, f"{path}/batch-*")
    return parse_objects(stored).select(string_field(F.col("row"), "text").alias("text"))


# --- files of other kinds


def text_files(spark, sf):
    """One text file for each source, with line ends of two characters, read back whole."""
    path = scratch_path(spark, "texts")
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    placed = docs.repartition("source").sortWithinPartitions("source", "doc_id").select("text", "source")
    placed.write.partitionBy("source").option("lineSep", "\r\n").text(path)
    read = read_documents(spark, "text", path)
    return read.select(F.shiftright("ord", FILE_SHIFT).alias("file_no"), "text")


def table_rows(spark, sf):
    """The training rows of a catalogue table with a split column."""
    name = f"rows_{uuid.uuid4().hex}"
    split = F.when(F.pmod("doc_id", F.lit(3)) == 0, "test").otherwise("train")
    stored = table(spark, sf, "documents").select("doc_id", "text", split.alias("split"))
    stored.write.option("path", scratch_path(spark, "table")).saveAsTable(name)
    try:
        return read_table(spark, name, columns=["doc_id", "text"]).select("doc_id", "text")
    finally:
        spark.sql(f"DROP TABLE {name}")  # its files stay


def blank_lines(spark, sf):
    """JSON lines with empty lines and lines of blanks among them."""
    path, kind = scratch_path(spark, "blank-lines"), F.pmod("doc_id", F.lit(4))
    blank = F.when(kind == 0, "\n").when(kind == 1, "\n \t").when(kind == 2, "\n\u3000\n  ").otherwise("")
    docs = table(spark, sf, "documents").select(F.concat(F.to_json(F.struct("doc_id", "text")), blank).alias("line"))
    docs.write.text(path)
    rows = parse_objects(read_lines(spark, path))
    return rows.select(F.try_variant_get("row", "$.doc_id", "bigint").alias("doc_id"), string_field(F.col("row"), "text").alias("text"))


def counts_fraction(spark, sf):
    """Counts with a fraction, in either case and with separators."""
    sums = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    tenths = F.floor(F.col("chars") / 100)
    label = F.concat(F.lit(" "), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.when(tenths % 2 == 0, "k").otherwise("M "))
    spaced = F.format_string("%s_%03d", F.floor(F.col("chars") / 1000), F.col("chars") % 1000)
    return sums.select("source", label.alias("label"), parse_count(label).alias("parsed"), parse_count(spaced).alias("plain"))


def tokenizer_json(spark, sf):
    """Counts of tokens by a vocabulary that was saved as JSON and loaded."""
    path = scratch_path(spark, "vocabulary") + ".json"
    tokenizer(spark, sf).save_json(spark, path)
    ids = Tokenizer.load_json(spark, path).encode(F.col("text"))
    return texts(spark, sf).select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"))


def eval_windows(spark, sf):
    """Batches of the training data's evaluation set, as a specification file asks for them."""
    paths = stored_mixture(spark, sf)
    values = {
        "train_datasets": [{"name": name, "tokenized_path": paths[name], "weight": weight} for name, weight in MIXTURE],
        "seq_len": SEQ_LEN, "batch_size": BATCH, "grad_accum_steps": ACCUMULATE, "seed": SEED, "num_workers": WORKERS, "learning_rate": 0.1,
    }
    path = scratch_path(spark, "run") + ".json"
    write_file(spark, path, json.dumps(values))
    run = load_run_spec(spark, path)
    total = open_datasets(spark, run.paths)[0].agg(F.sum("num_tokens").alias("n")).first().n
    found = run.batches(spark, total // (SEQ_LEN * WORKERS) // (BATCH * ACCUMULATE), "train_eval")
    return _plan_columns(found, "step", "batch_id", joined(F.col("x")).alias("x"), joined(F.col("y")).alias("y"))


QUERIES = (
    doc_filter, train_filter, parquet_positions, pretok_word_counts, pretok_doc_counts,
    bpe_pair_counts, bpe_train, bpe_vocab, bpe_encode, bpe_encode_counts, bpe_decode,
    char_vocabulary, char_encode, char_decode,
    shard_manifest, shard_manifest_small, doc_offsets, shard_of_document, dataset_totals, first_documents,
    corpus_blocks, binary_shards,
    chat_convert, chat_totals, chat_limited, chatml_render, role_map, content_parts, prompt_response, sft_labels, sft_totals,
    corpus_take, mixture_draws, window_starts, windows_pretrain, windows_sft, window_batches, step_tokens, source_report,
    normalise_rows, resume_topup, mixed_rebuild, sample_totals, seed_choice, counts_format, jsonl_documents, stream_encode,
    jsonl_limited, parquet_resume, token_table, chatml_file, blank_rows, windows_ranges, stream_chat,
    text_files, table_rows, blank_lines, counts_fraction, tokenizer_json, eval_windows, mixture_stream,
)


def prepare(spark: SparkSession, sf: str, labels: tuple[str, ...]) -> None:
    """Make the named shared results of ``_once`` and forget all others."""
    makers = {
        "tokenizer": tokenizer, "tokens": tokens, "plan": shard_plan, "mixture": mixture, "stored-mixture": stored_mixture, "chat-dataset": chat_dataset,
    }
    sf = sf.rstrip("/")
    for label in labels:
        makers[label](apply_settings(spark), sf)
    for key in [k for k in _made if k[2] not in labels]:
        del _made[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def settled(query):
        return lambda spark, sf: query(apply_settings(spark), sf.rstrip("/"))

    return {q.__name__: settled(q) for q in QUERIES}
