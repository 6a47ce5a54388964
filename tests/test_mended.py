"""Cases that once gave wrong rows in silence."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.operators import chat, samples
from millrace.operators.bpe_codec import Tokenizer
from millrace.operators.bpe_train import train_bpe, word_counts
from millrace.operators.cutoffs import limit_rows
from millrace.operators.quota import TokenizerSpec
from millrace.plans import samples as sample_plan
from millrace.plans.corpus import tokenise_corpus
from millrace.plans.training import parse_mixture
from millrace.session import shared_dir
from millrace.sinks.token_shards import read_shard_metas, read_token_table
from millrace.sources import registry
from millrace.sources.readers import read_documents


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """These run as users' plans do, with code generation."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture(scope="module")
def coder(spark):
    texts = spark.createDataFrame([(0, "some words of some text, words again")], "ord bigint, text string")
    return Tokenizer(train_bpe(word_counts(texts), 257 + 10))


def test_limit_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text": f"line {i} " + "x" * (i % 50)}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        rows = read_documents(spark, "jsonl", str(tmp_path / "a.jsonl"))
        limited = limit_rows(rows, 1000)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        assert [r.text.split()[1] for r in limited.orderBy("ord").collect()] == [str(i) for i in range(1000)]
        plan = limited._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Scan") == 2  # the lines and the list of files
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


@pytest.mark.parametrize("name", ["a b", "p%q", "c#d", "k[1]", "é+ü", "x{1,2}", "q?r", "s*t"])
def test_file_names(spark, tmp_path, name):
    for n in (name, "other"):
        (tmp_path / f"{n}.jsonl").write_text(json.dumps({"text": n}) + "\n")
    assert [r.text for r in read_documents(spark, "jsonl", str(tmp_path / f"{name}.jsonl")).collect()] == [name]
    assert [r.text for r in read_documents(spark, "jsonl", str(tmp_path)).orderBy("ord").collect()] == sorted([name, "other"])


def test_bad_shards_are_reported(spark, tmp_path, coder):
    docs = spark.createDataFrame([(i, "some words " * 20) for i in range(30)], "ord bigint, text string")
    out = str(tmp_path / "my shards")
    tokenise_corpus(docs, coder, out, 300, binary=True)
    shards = read_shard_metas(spark, out).count()
    assert shards > 2
    for content in ("{broken", json.dumps({"num_tokens": 3}), json.dumps({"dtype": "uint16"})):
        (tmp_path / "my shards" / "00001.meta.json").write_text(content)
        with pytest.raises(ValueError, match="00001"):
            read_shard_metas(spark, out)
    (tmp_path / "my shards" / "00001.meta.json").unlink()
    assert sorted(r.shard_id for r in read_shard_metas(spark, out).collect()) == [i for i in range(shards) if i != 1]


def test_token_table(spark, tmp_path, coder):
    docs = spark.createDataFrame([(i, "some words " * (i + 1)) for i in range(20)], "ord bigint, text string")
    manifest = {tuple(r)[:2] for r in tokenise_corpus(docs, coder, str(tmp_path / "t"), 100).select("shard_id", "num_tokens").collect()}
    stored, tokens = read_token_table(spark, str(tmp_path / "t"))
    assert {tuple(r) for r in stored.select("shard_id", "num_tokens").collect()} == manifest
    ends = tokens.groupBy("shard_id").agg(F.max(F.col("tok_start") + F.size("ids")).alias("n"))
    assert {tuple(r) for r in ends.collect()} == manifest
    with pytest.raises(FileNotFoundError):
        read_token_table(spark, str(tmp_path / "none"))


def test_evaluation_keeps_its_own_path():
    entry = lambda path, **more: {"name": "web", "tokenized_path": path, **more}
    paths, train, evaluate = parse_mixture({"train_datasets": [entry("T"), entry("T"), entry("U")], "eval_datasets": [entry("E"), entry("T")]})
    assert [paths[s.name] for s in train] == ["T", "T", "U"]
    assert [paths[s.name] for s in evaluate] == ["E", "T"]


@pytest.mark.parametrize("turn", [{"content": "x"}, {"role": "user"}, {"role": "user", "content": ["x"]}, {"role": 3, "content": "x"}])
def test_bad_turns_fail(spark, turn):
    rows = spark.createDataFrame([(0, json.dumps({"messages": [turn]}))], "ord bigint, line string")
    with pytest.raises(Exception, match="a role and a content"):
        chat.require_messages(rows.select("ord", F.parse_json("line").alias("row"))).collect()


def test_numbers_are_no_text(spark):
    rows = spark.createDataFrame([(0, 5, "s"), (1, 6, "s")], "ord bigint, text bigint, source string")
    assert samples.normalise_columns(rows, "d").count() == 0


def test_checks_come_before_the_work(spark, tmp_path, coder):
    (tmp_path / "out").mkdir()
    fails = spark.range(1).select(F.col("id").alias("ord"), F.raise_error(F.lit("ran")).cast("string").alias("text"))
    for binary in (False, True):
        with pytest.raises(FileExistsError):
            tokenise_corpus(fails, coder, str(tmp_path / "out"), binary=binary)


def test_half_written_part_is_redone(spark, tmp_path, monkeypatch):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.jsonl").write_text("".join(json.dumps({"text": str(i)}) + "\n" for i in range(9)))
    monkeypatch.setitem(registry.SOURCES, "mine", registry.CorpusSource("mine", "jsonl", ["1.jsonl"], "text"))
    left = tmp_path / "root" / "pretrain" / "mine_5" / "from-000000000000"
    left.mkdir(parents=True)
    (left / "part-00000.txt").write_text("half\n")
    path, rows = sample_plan.extend_sample(spark, str(tmp_path / "root"), "mine", 5, str(tmp_path / "c"))
    assert rows == 5 and spark.read.option("recursiveFileLookup", "true").text(path).where("value = 'half'").count() == 0


def test_vocabulary_file(spark, tmp_path, coder):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(tmp_path / "v.json")
    coder.save_json(spark, path)
    library = tokenizers.Tokenizer.from_file(path)
    again = Tokenizer.load_json(spark, path)
    text = "some other words, é\n again"
    ids = spark.createDataFrame([(text,)], "text string").select(again.encode(F.col("text"))).first()[0]
    assert ids == library.encode(text).ids and library.decode(ids) == text
    (tmp_path / "bad.json").write_text(json.dumps({"model": {"vocab": {"a": 0}, "merges": []}}))
    with pytest.raises(ValueError, match="byte alphabet"):
        Tokenizer.load_json(spark, str(tmp_path / "bad.json"))


def test_specification_keys():
    with pytest.raises(ValueError, match="vocabsize"):
        TokenizerSpec.of({"raw_datasets": [{"name": "a", "kind": "jsonl", "path": "p"}], "path": "t", "vocabsize": 10})
