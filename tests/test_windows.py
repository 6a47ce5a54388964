import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.windows import (
    Fetch, MASKED, MixtureSource, SAMPLE_SETS, SLOT, batches, cut_windows, mixture_report, pretrain_windows, source_draws, supervised_places, supervised_windows, token_accounting, token_blocks, usable_shards, validate_mixture, window_plan,
)
from millrace.plans.training import parse_mixture, sample_set
from millrace.streaming.draws import stream_draws, write_draws

SHARDS = {("a", 0): 90, ("a", 1): 7, ("a", 2): 40, ("b", 0): 33, ("b", 1): 200}
BLOCK = 12


@pytest.fixture(scope="module")
def data(spark):
    """Shards of random documents: (documents, manifest, {shard: ids}, {shard: labels})."""
    rng, rows, ids, labels = random.Random(1), [], {}, {}
    for (source, shard), size in SHARDS.items():
        ids[source, shard] = [rng.randrange(1000) for _ in range(size)]
        labels[source, shard] = [t if rng.random() < 0.05 else MASKED for t in ids[source, shard]]
        at = 0
        while at < size:
            n = min(size - at, rng.choice([1, 3, 11, 50]))
            rows.append((source, shard, at, ids[source, shard][at : at + n], labels[source, shard][at : at + n]))
            at += n
    docs = spark.createDataFrame(rows, "source string, shard_id int, tok_start bigint, ids array<int>, labels array<int>").repartition(5).cache()
    manifest = spark.createDataFrame([(s, k, n, 3) for (s, k), n in SHARDS.items()], "source string, shard_id int, num_tokens bigint, num_docs bigint")
    return docs, manifest, ids, labels


def test_blocks_hold_the_shard(spark, data):
    docs, _, ids, labels = data
    for r in token_blocks(docs, BLOCK).collect():
        span = slice(r.block_id * BLOCK, (r.block_id + 1) * BLOCK)
        assert r.ids == ids[r.source, r.shard_id][span] and r.labels == labels[r.source, r.shard_id][span]
    for r in token_blocks(docs, BLOCK, 17).collect():
        span = slice(r.block_id * BLOCK, (r.block_id + 1) * BLOCK + 17)
        assert r.ids == ids[r.source, r.shard_id][span] and r.labels == labels[r.source, r.shard_id][span]
    assert token_blocks(docs, BLOCK).count() == sum(-(-n // BLOCK) for n in SHARDS.values())


@pytest.mark.parametrize("seq_len", [5, 12, 30])
def test_windows_shift_by_one(spark, data, seq_len):
    docs, manifest, ids, _ = data
    mix = [MixtureSource("a", 1.0), MixtureSource("b", 3.0)]
    draws = source_draws(spark, mix, 150, 9, workers=2)
    rows = pretrain_windows(draws, manifest, token_blocks(docs.drop("labels"), BLOCK, seq_len), ["a", "b"], seq_len, BLOCK).collect()
    assert len(rows) == 300 and len({(r.worker, r.draw) for r in rows}) == 300
    for r in rows:
        shard = ids[r.source, r.shard_id]
        assert len(shard) > seq_len + 1 and 0 <= r.start < len(shard) - seq_len - 1
        assert r.x == shard[r.start : r.start + seq_len] and r.y == shard[r.start + 1 : r.start + seq_len + 1]


def test_too_small_an_overlap_fails(spark, data):
    docs, manifest, _, _ = data
    draws = source_draws(spark, [MixtureSource("b")], 50, 9)
    with pytest.raises(Exception, match="overlap"):
        pretrain_windows(draws, manifest, token_blocks(docs, BLOCK, 2), ["b"], 10, BLOCK).collect()


def test_draw_shares_follow_weights_and_tokens(spark, data):
    _, manifest, _, _ = data
    n = 6000
    draws = source_draws(spark, [MixtureSource("a", 0.25), MixtureSource("b", 0.75)], n, 3).withColumn("attempt", F.lit(0))
    plan = window_plan(draws, usable_shards(manifest, 5, ["a", "b"]), 5)
    shares = {(r.source, r.shard_id): r["count"] / n for r in plan.groupBy("source", "shard_id").count().collect()}
    for (source, shard), size in SHARDS.items():
        total = sum(v for (s, k), v in SHARDS.items() if s == source)
        expected = {"a": 0.25, "b": 0.75}[source] * size / total
        assert abs(shares[source, shard] - expected) < 4 * (expected / n) ** 0.5 + 1e-9


def test_usable_shards_need_two_more_tokens(spark):
    manifest = spark.createDataFrame([("a", 0, 11), ("a", 1, 12)], "source string, shard_id int, num_tokens bigint")
    assert [r.shard_id for r in usable_shards(manifest, 10, ["a"]).collect()] == [1]
    with pytest.raises(ValueError, match="long enough"):
        usable_shards(manifest, 11, ["a"])


def test_the_only_start_is_zero(spark):
    manifest = spark.createDataFrame([("a", 1, 12)], "source string, shard_id int, num_tokens bigint")
    draws = source_draws(spark, [MixtureSource("a")], 50, 1).withColumn("attempt", F.lit(0))
    assert {r.start for r in window_plan(draws, usable_shards(manifest, 10, ["a"]), 10).collect()} == {0}


def test_supervised_windows_redraw(spark, data):
    docs, manifest, ids, labels = data
    blocks = token_blocks(docs, BLOCK, 6)
    draws = source_draws(spark, [MixtureSource("a"), MixtureSource("b")], 60, 4)
    rows = supervised_windows(draws, manifest, blocks, ["a", "b"], 6, BLOCK).collect()
    assert len({r.draw for r in rows}) == len(rows) == 60 and max(r.attempt for r in rows) > 0
    for r in rows:
        key = (r.source, r.shard_id)
        assert r.x == ids[key][r.start : r.start + 6] and r.y == labels[key][r.start + 1 : r.start + 7]
        assert any(v != MASKED for v in r.y)


def test_windows_without_supervision_raise(spark, data):
    docs, manifest, _, _ = data
    masked = token_blocks(docs.withColumn("labels", F.transform("labels", lambda v: F.lit(MASKED))), BLOCK, 6)
    with pytest.raises(RuntimeError, match="100 attempts"):
        supervised_windows(source_draws(spark, [MixtureSource("a")], 3, 4), manifest, masked, ["a"], 6, BLOCK)


def test_workers_and_sample_sets_have_their_own_seed(spark, data):
    docs, manifest, _, _ = data
    mix = [MixtureSource("a"), MixtureSource("b")]
    one = source_draws(spark, mix, 100, 5, workers=2)
    other = source_draws(spark, mix, 100, 6)
    as_rows = lambda df: [r.source for r in df.orderBy("draw").collect()]
    assert as_rows(one.where("worker = 1")) == as_rows(other)
    blocks = token_blocks(docs, BLOCK, 5)
    sets = {
        name: [(r.source, r.shard_id, r.start) for r in sample_set(manifest, blocks, mix, 40, 5, BLOCK, 7, name).orderBy("draw").collect()]
        for name in SAMPLE_SETS
    }
    assert len({tuple(v) for v in sets.values()}) == 3
    again = sample_set(manifest.repartition(3), blocks.repartition(6), mix, 40, 5, BLOCK, 7 + 10_000)
    assert [(r.source, r.shard_id, r.start) for r in again.orderBy("draw").collect()] == sets["train_eval"]
    with pytest.raises(ValueError):
        sample_set(manifest, blocks, mix, 1, 5, BLOCK, 7, mode="other")


def test_batches_and_accounting(spark):
    draws = source_draws(spark, [MixtureSource("a")], 20, 1)
    rows = {r.draw: (r.batch_id, r.step) for r in batches(draws, 3, 2).collect()}
    assert rows == {d: (d // 3, d // 6) for d in range(20)}
    steps = token_accounting(draws, 3, 10, 2).orderBy("step").collect()
    assert [(r.step, r.windows, r.tokens_seen) for r in steps] == [(0, 6, 60), (1, 6, 120), (2, 6, 180), (3, 2, 240)]


def test_report(spark, data):
    _, manifest, _, _ = data
    rows = {r.source: tuple(r)[1:] for r in mixture_report(manifest, [MixtureSource("a", 0.5), MixtureSource("b", 2)]).collect()}
    assert rows == {"a": (0.5, 3, 137, 9), "b": (2.0, 2, 233, 6)}


def test_mixtures_are_checked():
    for bad in ([], [MixtureSource("a", 0)], [MixtureSource("a"), MixtureSource("a")]):
        with pytest.raises(ValueError):
            validate_mixture(bad)
    paths, train, evaluate = parse_mixture({"train_datasets": [{"name": "a", "tokenized_path": "p", "weight": 2}]})
    assert paths == {"a": "p"} and train == evaluate == [MixtureSource("a", 2)]
    for bad in ({}, {"train_datasets": [{"name": "a"}]}):
        with pytest.raises(ValueError):
            parse_mixture(bad)


def test_places_of_supervised_tokens(spark, data):
    docs, _, _, labels = data
    slots = {(r.source, r.shard_id, r.slot): r for r in supervised_places(docs).collect()}
    assert len(slots) == supervised_places(docs).count()
    for (source, shard), values in labels.items():
        places = [i for i, v in enumerate(values) if v != MASKED]
        for slot in range(len(values) // SLOT + 1):
            row = slots.get((source, shard, slot))
            behind = [p for p in places if p >= (slot + 1) * SLOT]
            own = [p - slot * SLOT for p in places if p // SLOT == slot]
            if own or behind:
                assert row.mask == sum(1 << i for i in own) and row.next == (behind[0] if behind else None)
            else:
                assert row is None


def test_redraws_read_each_window_once(spark, data):
    """However many attempts a draw takes, its tokens are fetched once, after the attempt is known."""
    docs, manifest, _, _ = data
    blocks, calls = token_blocks(docs, BLOCK, 6), []

    def windows(plan, seq_len, targets):
        calls.append(plan.groupBy("worker", "draw").count().agg(F.max("count"), F.count("*")).first())
        return cut_windows(plan, blocks, seq_len, BLOCK, targets)

    places = supervised_places(docs)
    draws = source_draws(spark, [MixtureSource("a"), MixtureSource("b")], 80, 4)
    found = supervised_windows(draws, manifest, Fetch(windows, lambda: places), ["a", "b"], 6, BLOCK)
    assert sorted(found.collect()) == sorted(supervised_windows(draws, manifest, blocks, ["a", "b"], 6, BLOCK).collect())
    assert [tuple(c) for c in calls] == [(1, 80)] and found.agg(F.max("attempt")).first()[0] > 7


def test_draws_as_a_stream_go_on_where_they_stopped(spark, data, tmp_path):
    docs, manifest, _, _ = data
    sources, blocks = [MixtureSource("a", 2.0), MixtureSource("b")], token_blocks(docs.drop("labels"), BLOCK, 6)
    make = lambda draws: pretrain_windows(draws, manifest, blocks, ["a", "b"], 6, BLOCK)
    path, mark = tmp_path / "out", tmp_path / "mark"
    for batches_done in (1, 2, 3):
        write_draws(stream_draws(spark, sources, 15, 9, 2), make, str(path), str(mark)).awaitTermination()
        assert len(list(path.glob("batch-*"))) == batches_done
    whole = make(source_draws(spark, sources, 45, 9, 2))
    stored = lambda: sorted(spark.read.parquet(f"{path}/batch-*").where("draw < 45").select(whole.columns).collect())
    assert stored() == sorted(whole.collect()) and whole.count() == 90
    # A batch that was written but not noted as done is made again.
    (mark / "commits" / "2").unlink()
    (mark / "commits" / ".2.crc").unlink(missing_ok=True)
    write_draws(stream_draws(spark, sources, 15, 9, 2), make, str(path), str(mark)).awaitTermination()
    assert stored() == sorted(whole.collect())
