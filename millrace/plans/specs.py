"""Specification files: tokenizer training and training runs, as YAML or JSON on any Hadoop file system."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.quota import TokenizerSpec
from millrace.operators.windows import MixtureSource, batches
from millrace.plans.training import open_datasets, parse_mixture, sample_set
from millrace.sources.paths import read_file

try:  # JSON is read without it
    import yaml
except ModuleNotFoundError:
    yaml = None

BLOCK = 4096


def read_spec(spark: SparkSession, path: str) -> dict:
    """The mapping in a YAML or JSON file; an empty file is an empty mapping."""
    content = read_file(spark, path)
    if path.endswith(".json"):
        values = json.loads(content or "{}")
    elif yaml is None:
        raise RuntimeError(f"reading {path} needs PyYAML")
    else:
        values = yaml.safe_load(content) or {}
    if not isinstance(values, dict):
        raise ValueError(f"not a mapping: {path}")
    return values


def load_tokenizer_spec(spark: SparkSession, path: str) -> TokenizerSpec:
    return TokenizerSpec.of(read_spec(spark, path))


@dataclass(frozen=True)
class RunSpec:
    """What a training run draws: its datasets with their weights, and windows of ``seq_len`` tokens in batches.

    ``paths`` are the token datasets by the keys that ``train`` and ``evaluate`` use. Fields of a file that describe the model or the
    optimiser mean nothing here and are left aside.
    """

    paths: dict[str, str]
    train: list[MixtureSource]
    evaluate: list[MixtureSource]
    seq_len: int
    batch_size: int
    accumulate: int
    seed: int
    workers: int

    @classmethod
    def of(cls, values: dict) -> RunSpec:
        # What a file leaves out.
        given = {"seq_len": 128, "batch_size": 32, "grad_accum_steps": 1, "seed": 42, "num_workers": 0} | {k: v for k, v in values.items() if v is not None}
        paths, train, evaluate = parse_mixture(given)
        return cls(paths, train, evaluate, given["seq_len"], given["batch_size"], given["grad_accum_steps"], given["seed"], max(1, given["num_workers"]))

    def batches(self, spark: SparkSession, steps: int, name: str = "train", mode: str = "pretrain") -> DataFrame:
        """The windows of ``steps`` training steps of each worker, with step and batch_id, of one of the three sample sets."""
        sources = self.evaluate if name == "eval" else self.train
        manifest, fetch = open_datasets(spark, {s.name: self.paths[s.name] for s in sources})
        windows = sample_set(manifest, fetch, sources, steps * self.batch_size * self.accumulate, self.seq_len, BLOCK, self.seed, name, mode, self.workers)
        return batches(windows, self.batch_size, self.accumulate)


def load_run_spec(spark: SparkSession, path: str) -> RunSpec:
    return RunSpec.of(read_spec(spark, path))
