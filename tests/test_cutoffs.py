import random

from pyspark.sql import functions as F

from millrace.operators import cutoffs, prefix
from millrace.operators.cutoffs import hash_bucket, limit_rows, ord_bucket, take_between, take_first
from millrace.operators.quota import CorpusSpec, TokenizerSpec, mixed_corpus, quotas, shuffle_key, validate_corpora

import pytest


def test_take_and_skip_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(cutoffs, "ORD_BUCKET_BITS", 3)
    monkeypatch.setattr(prefix, "GROUP_BITS", 2)
    rng = random.Random(3)
    # One source holds most of the rows.
    data = [(rng.choice("aaaaab"), o) for o in rng.sample(range(500), 150)] + [("c", 1000)]
    rows = spark.createDataFrame(data, "source string, ord bigint").repartition(5)
    wants = {"a": 37, "b": 1000, "c": 0}
    wanted = spark.createDataFrame(list(wants.items()), "source string, n bigint")
    by_source = {s: sorted(o for t, o in data if t == s) for s in "abc"}
    taken = take_first(rows, "source", "ord", ord_bucket(F.col("ord")), wanted).collect()
    assert sorted((r.source, r.ord) for r in taken) == sorted((s, o) for s in "abc" for o in by_source[s][: wants[s]])
    spans = {"a": (11, 37), "b": (2, 3), "c": (0, 5)}
    between = spark.createDataFrame([(k, *v) for k, v in spans.items()], "source string, skip bigint, n bigint")
    left = take_between(rows, "source", "ord", ord_bucket(F.col("ord")), between).collect()
    assert sorted((r.source, r.ord) for r in left) == sorted((s, o) for s in "abc" for o in by_source[s][slice(*spans[s])])


def test_limit_keeps_at_least_one(spark, monkeypatch):
    monkeypatch.setattr(cutoffs, "ORD_BUCKET_BITS", 2)
    rows = spark.range(100).select((F.col("id") * 3).alias("ord")).repartition(4)
    for n in (0, 1, 5, 100, 500):
        assert sorted(r.ord for r in limit_rows(rows, n).collect()) == [i * 3 for i in range(max(1, min(n, 100)))]


def test_quotas_round_half_to_even_and_keep_the_local_weight(spark):
    corpora = [CorpusSpec("a", "jsonl", 2.5, path="p"), CorpusSpec("b", "jsonl", 3.5, path="p"), CorpusSpec("c", "local", 3.0, path="p"), CorpusSpec("d", "parquet", 1e-9, path="p")]
    got = {r.source: r.n for r in quotas(spark, corpora, 9).collect()}
    assert got == {"a": round(9 * 2.5 / (9.0 + 1e-9)), "b": round(9 * 3.5 / (9.0 + 1e-9)), "c": 1, "d": 1}
    halves = [CorpusSpec("a", "jsonl", 1, path="p"), CorpusSpec("b", "jsonl", 1, path="p")]
    assert {r.n for r in quotas(spark, halves, 5).collect()} == {2}


def test_mixed_corpus(spark):
    docs = spark.range(60).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").alias("ord"), F.lit("t").alias("text"))
    corpora = [CorpusSpec("s0", "parquet", 1, path="p"), CorpusSpec("s1", "jsonl", 1, path="p"), CorpusSpec("s2", "parquet", 1, path="p", shuffle_buffer=0)]
    rows = mixed_corpus(docs, TokenizerSpec(corpora, "-", max_documents=15, seed=7)).collect()
    for i, name in enumerate(("s1", "s2"), 1):
        assert sorted(r.ord for r in rows if r.source == name) == [i + 3 * k for k in range(5)]
    keys = docs.where("source = 's0'").select("ord", shuffle_key(7, F.lit(0), F.col("ord")).alias("k")).orderBy("k").limit(5)
    assert {r.ord for r in rows if r.source == "s0"} == {r.ord for r in keys.collect()}
    assert [r.source for r in sorted(rows, key=lambda r: (r.src_ord, r.place, r.ord))] == ["s0"] * 5 + ["s1"] * 5 + ["s2"] * 5
    assert hash_bucket  # used for shuffled sources


def test_specifications_are_checked():
    with pytest.raises(ValueError):
        TokenizerSpec.of({"path": "p"})
    with pytest.raises(ValueError):
        TokenizerSpec.of({"raw_datasets": [{"name": "a", "kind": "jsonl"}]})
    spec = TokenizerSpec.of({"train_datasets": [{"name": "a", "kind": "jsonl", "path": "x"}], "path": "p"})
    assert (spec.vocab_size, spec.max_documents, spec.shuffle_buffer, spec.seed) == (8192, 100_000, 10_000, 42)
    for bad in (CorpusSpec("a", "csv", path="x"), CorpusSpec("a", "jsonl"), CorpusSpec("a", "table"), CorpusSpec("a", "jsonl", -1, path="x")):
        with pytest.raises(ValueError):
            validate_corpora([bad])
