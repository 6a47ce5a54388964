import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.shards import dataset_manifest, plan_shards


def next_fit(sizes, limit):
    shards, used = [[]], 0
    for i, n in enumerate(sizes):
        if shards[-1] and used + n > limit:
            shards.append([])
            used = 0
        shards[-1].append(i)
        used += n
    return shards


@pytest.mark.parametrize("seed,limit,chunk", [(0, 50, 1000), (1, 50, 7), (2, 500, 5), (3, 20, 3), (4, 1, 10), (5, 10_000, 4), (6, 100, 16)])
def test_shards_equal_a_sequential_pass(spark, seed, limit, chunk):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 9, 10, 40, 50, 51, 200]) for _ in range(120)]
    ords = sorted(rng.sample(range(10**6), len(sizes)))
    rows = spark.createDataFrame(list(zip(ords, sizes)), "ord bigint, n int").repartition(4)
    plan = plan_shards(rows.union(spark.createDataFrame([(-1, 0)], "ord bigint, n int")), limit, chunk)
    expected = next_fit(sizes, limit)
    got = plan.manifest().orderBy("shard_id").collect()
    assert [(r.shard_id, r.first_ord, r.num_docs, r.num_tokens) for r in got] == [
        (k, ords[s[0]], len(s), sum(sizes[i] for i in s)) for k, s in enumerate(expected)
    ]
    where = {r.ord: r for r in plan.documents().collect()}
    for k, shard in enumerate(expected):
        used = 0
        for i in shard:
            assert (where[ords[i]].shard_id, where[ords[i]].tok_start, where[ords[i]].tok_end) == (k, used, used + sizes[i])
            used += sizes[i]
    attached = dict(plan.attach(rows.select("ord")).collect())
    assert attached == {o: r.shard_id for o, r in where.items()}


def test_joined_shard_ids_equal_searched_ones(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("ord"), (F.col("id") % 7 + 1).alias("n"))
    plan = plan_shards(rows, 20, 30)
    searched = dict(plan.attach(rows.select("ord")).collect())
    monkeypatch.setattr("millrace.operators.shards.STARTS_ON_DRIVER", 1)
    assert dict(plan.attach(rows.select("ord")).collect()) == searched


def test_no_documents_give_one_empty_shard(spark):
    plan = plan_shards(spark.createDataFrame([], "ord bigint, n int"), 10)
    assert [(r.shard_id, r.num_docs, r.num_tokens) for r in plan.manifest().collect()] == [(0, 0, 0)]
    assert dataset_manifest(plan.manifest(), "uint16").collect() == [(1, 0, 0, "uint16")]


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        plan_shards(spark.createDataFrame([(1, 1)], "ord bigint, n int"), 0)
