"""Training windows from token datasets: train, train-eval and eval sample sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.windows import (
    SAMPLE_SETS,
    Fetch,
    MixtureSource,
    pretrain_windows,
    source_draws,
    supervised_windows,
    validate_mixture,
)
from millrace.session import materialise
from millrace.sinks.token_shards import is_token_table, read_binary_blocks, read_places, read_shard_metas, read_table_groups, read_table_manifest, read_table_windows, read_windows


def parse_mixture(values: dict) -> tuple[dict[str, str], list[MixtureSource], list[MixtureSource]]:
    """(paths by key, training sources, evaluation sources); evaluation defaults to training.

    A source's key is its name, or the name and a number where entries of that name have other paths
    or stand in one list twice; so a training and an evaluation entry of one name keep their own data.
    """
    if not values.get("train_datasets"):
        raise ValueError("a mixture needs train_datasets")
    train = values["train_datasets"]
    evaluate = values.get("eval_datasets") or train
    for item in [*train, *evaluate]:
        if not item.get("tokenized_path"):
            raise ValueError(f"a source needs a tokenized_path: {item.get('name')}")
    paths: dict[str, str] = {}

    def as_sources(items: list[dict]) -> list[MixtureSource]:
        out: list[MixtureSource] = []
        for item in items:
            key, number = item["name"], 1
            while paths.get(key, item["tokenized_path"]) != item["tokenized_path"] or key in [s.name for s in out]:
                number += 1
                key = f"{item['name']}#{number}"
            paths[key] = item["tokenized_path"]
            out.append(MixtureSource(key, item.get("weight", 1.0)))
        return validate_mixture(out)

    sources = as_sources(train)
    return paths, sources, as_sources(evaluate)


def load_datasets(
    spark: SparkSession, paths: dict[str, str], block_size: int, seq_len: int, labelled: bool
) -> tuple[DataFrame, DataFrame]:
    """(manifest, blocks) of binary token datasets by source name, for windows of ``seq_len`` tokens."""
    metas = {name: read_shard_metas(spark, path) for name, path in paths.items()}
    manifest = [m.select(F.lit(name).alias("source"), "shard_id", "num_tokens", "num_docs") for name, m in metas.items()]
    blocks = [read_binary_blocks(m, name, block_size, seq_len, labelled) for name, m in metas.items()]
    return reduce(DataFrame.unionByName, manifest), materialise(reduce(DataFrame.unionByName, blocks), "blocks")


def open_datasets(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, Fetch]:
    """(manifest, fetch) of token datasets by source name, each binary or a token table.

    ``fetch`` reads planned windows only: their bytes from binary shards, their row groups from tables.
    """
    tables = {name: path for name, path in paths.items() if is_token_table(spark, path)}
    named = lambda df, name: df.withColumn("source", F.lit(name))
    binary = [named(read_shard_metas(spark, path), name) for name, path in paths.items() if name not in tables]
    metas = materialise(reduce(DataFrame.unionByName, binary), "shard-metas") if binary else None
    groups = materialise(reduce(DataFrame.unionByName, [named(read_table_groups(spark, path), name) for name, path in tables.items()]), "table-groups") if tables else None
    columns = ["source", "shard_id", "num_tokens", "num_docs"]
    manifests = [metas.select(*columns)] if binary else []
    manifests += [named(read_table_manifest(spark, path), name).select(*columns) for name, path in tables.items()]

    def fetch(plan: DataFrame, seq_len: int, targets: str) -> DataFrame:
        if not tables:
            return read_windows(plan, metas, seq_len, targets)
        stored = read_table_windows(plan.where(F.col("source").isin(*tables)), groups, seq_len, targets)
        if not binary:
            return stored
        return stored.unionByName(read_windows(plan.where(~F.col("source").isin(*tables)), metas, seq_len, targets))

    def places() -> DataFrame:
        return reduce(DataFrame.unionByName, [named(read_places(spark, path), name) for name, path in paths.items()])

    return reduce(DataFrame.unionByName, manifests), Fetch(fetch, places)


def sample_set(
    manifest: DataFrame,
    blocks: DataFrame | Fetch,
    sources: list[MixtureSource],
    n: int,
    seq_len: int,
    block_size: int,
    seed: int,
    name: str = "train",
    mode: str = "pretrain",
    workers: int = 1,
) -> DataFrame:
    """``n`` windows per worker of one of the three sample sets, from the blocks or the fetch function of the datasets."""
    if mode not in ("pretrain", "sft"):
        raise ValueError(f"unknown mode: {mode}")
    draws = source_draws(manifest.sparkSession, sources, n, seed + SAMPLE_SETS[name], workers)
    build = pretrain_windows if mode == "pretrain" else supervised_windows
    return build(draws, manifest, blocks, [s.name for s in sources], seq_len, block_size)
