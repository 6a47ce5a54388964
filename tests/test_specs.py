import json

import pytest

from millrace.operators.quota import CorpusSpec, TokenizerSpec
from millrace.operators.windows import MixtureSource
from millrace.plans import specs

TOKENIZER = """
seed: 7
shuffle_buffer_size: 0
tokenizer_path: out/t.json
tokenizer_vocab_size: 300
tokenizer_train_max_documents: 50

raw_datasets:
  - name: web
    data_source: parquet
    data_path: data/*.parquet
    text_column: content
    weight: 0.5
  - name: listed
    data_source: hf
    dataset_name: some.table
    dataset_config: part
    dataset_split: all
    shuffle_buffer_size: 9
  - name: note
    data_source: local
    data_path: note.txt
    dataset_name: null
"""

RUN = """
batch_size: 4
seq_len: 16
grad_accum_steps: 2
learning_rate: 0.0003
resume_path: null
train_datasets:
  - {name: a, tokenized_path: x/a, weight: 0.75}
  - {name: b, tokenized_path: x/b, weight: 0.25}
eval_datasets:
  - {name: a, tokenized_path: x/val, weight: 1.0}
"""


def test_tokenizer_files(spark, tmp_path):
    (tmp_path / "t.yaml").write_text(TOKENIZER)
    spec = specs.load_tokenizer_spec(spark, str(tmp_path / "t.yaml"))
    assert spec == TokenizerSpec([
        CorpusSpec("web", "parquet", 0.5, "data/*.parquet", text_column="content"),
        CorpusSpec("listed", "table", 1.0, table="some.table.part", split="all", shuffle_buffer=9), CorpusSpec("note", "local", path="note.txt"),
    ], "out/t.json", 300, 50, 0, 7)
    short = {"raw_datasets": [{"name": "web", "kind": "jsonl", "path": "p"}], "path": "t"}
    (tmp_path / "t.json").write_text(json.dumps(short))
    assert specs.load_tokenizer_spec(spark, str(tmp_path / "t.json")) == TokenizerSpec.of(short)
    for bad in ({"path": "t", "tokenizer_path": "t"}, {"path": "t", "raw_datasets": [{"name": "a", "kind": "jsonl", "data_source": "jsonl"}]}, {"tokenizer_path": "t", "raw_datasets": [{"name": "a", "data_source": "jsonl", "data_paths": "x"}]}):
        with pytest.raises((ValueError, TypeError)):
            TokenizerSpec.of({"raw_datasets": short["raw_datasets"], **bad})


def test_run_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(RUN)
    run = specs.load_run_spec(spark, str(tmp_path / "r.yaml"))
    assert (run.seq_len, run.batch_size, run.accumulate, run.seed, run.workers) == (16, 4, 2, 42, 1)
    assert run.train == [MixtureSource("a", 0.75), MixtureSource("b", 0.25)] and run.evaluate == [MixtureSource("a#2", 1.0)]
    assert run.paths == {"a": "x/a", "b": "x/b", "a#2": "x/val"}
    (tmp_path / "e.yaml").write_text("")
    (tmp_path / "l.yaml").write_text("- 1")
    for name in ("e.yaml", "l.yaml"):
        with pytest.raises(ValueError):
            specs.load_run_spec(spark, str(tmp_path / name))
