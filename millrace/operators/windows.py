"""Token blocks, weighted draws and training windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.merging import take_runs
from millrace.functions.numbers import uniform
from millrace.operators.prefix import with_sum_before
from millrace.session import materialise

MASKED = -100  # label of a token that is not supervised
MAX_ATTEMPTS = 100
SHARD = ["source", "shard_id"]
SPAN_TOKENS = 1 << 18  # tokens cut into blocks at once
BLOCKS_AT_ONCE = 1024
SLOT = 32  # tokens of a slot, whose places fit the bits of a mask


@dataclass(frozen=True)
class Fetch:
    """Stored token datasets: ``windows`` adds the tokens to planned windows (plan, seq_len, targets) and ``places`` gives
    ``supervised_places`` of them."""

    windows: Callable[[DataFrame, int, str], DataFrame]
    places: Callable[[], DataFrame]

    def __call__(self, plan: DataFrame, seq_len: int, targets: str) -> DataFrame:
        return self.windows(plan, seq_len, targets)


@dataclass(frozen=True)
class MixtureSource:
    name: str
    weight: float = 1.0


def validate_mixture(sources: list[MixtureSource]) -> list[MixtureSource]:
    if not sources:
        raise ValueError("a mixture needs at least one source")
    for s in sources:
        if s.weight <= 0:
            raise ValueError(f"the weight of a source must be positive: {s.name}")
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("source names must differ")
    return sources


def token_blocks(documents: DataFrame, block_size: int, overlap: int = 0) -> DataFrame:
    """(source, shard_id, block_id, ids[, labels]): shards cut into blocks of ``block_size`` tokens.

    A block goes on into the next ones by ``overlap`` tokens, so that a window of that length
    lies in the block it starts in. ``documents`` has source, shard_id, tok_start, ids and
    maybe labels. Documents are cut at the edges of spans of many blocks and moved once, by span; a task
    cuts the blocks of a span after the other, and holds the tokens of one.
    """
    arrays = [c for c in ("ids", "labels") if c in documents.columns]
    per = max(1, SPAN_TOKENS // block_size)
    size = F.lit(per * block_size).cast("bigint")
    stop = F.col("tok_start") + F.size("ids")

    def piece(span: Column) -> Column:
        start = F.greatest(F.col("tok_start"), span * size)
        length = (F.least(stop, (span + 1) * size + overlap) - start).cast("int")
        skip = (start - F.col("tok_start") + 1).cast("int")
        return F.struct(span.alias("span"), start.alias("start"), *[F.slice(a, skip, length).alias(a) for a in arrays])

    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("tok_start") - overlap) / size))
    spans = F.sequence(first, F.floor((stop - 1) / size))
    pieces = documents.where(F.size("ids") > 0).select(*SHARD, F.explode(F.transform(spans, piece)).alias("p")).select(*SHARD, "p.*")
    dealt = pieces.repartition(*SHARD, "span").sortWithinPartitions(*SHARD, "span", "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # a span's pieces hold its tokens and the overlap, however many batches they come in
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in (*SHARD, "span")], strict=True))
            opens = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(opens, opens[1:]):
                if a == b:
                    continue
                if held and keys[a] != key:
                    yield from _span_blocks(key, held, arrays, block_size, overlap, per)
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _span_blocks(key, held, arrays, block_size, overlap, per)

    shard = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*SHARD).schema)
    return dealt.mapInArrow(cut, f"{shard}, block_id bigint, " + ", ".join(f"{a} array<int>" for a in arrays))


def _span_blocks(key: tuple, held: list[pa.RecordBatch], arrays: list[str], block_size: int, overlap: int, per: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one span, each of its pieces in the order of their starts."""
    source, shard, span = key
    starts = np.concatenate([h.column("start").to_numpy() for h in held])
    lists = {a: pa.concat_arrays([h.column(a) for h in held]) for a in arrays}
    sizes = lists["ids"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = {a: lists[a].flatten().to_numpy(zero_copy_only=False) for a in arrays}
    low = np.maximum((starts - overlap) // block_size, span * per)
    high = np.minimum((starts + sizes - 1) // block_size, span * per + per - 1)
    row = np.repeat(np.arange(len(starts)), high - low + 1)
    block = take_runs(low, high - low + 1)
    begin = np.maximum(starts[row], block * block_size)
    length = np.minimum(starts[row] + sizes[row], (block + 1) * block_size + overlap) - begin
    at = (np.cumsum(sizes) - sizes)[row] + begin - starts[row]
    order = np.lexsort((begin, block))
    tied = (np.diff(block[order]) == 0) & (np.diff(begin[order]) == 0)
    if tied.any():  # documents that share an ord also share places; their tokens decide
        order = np.array(sorted(order, key=lambda i: (block[i], begin[i], *[values[a][at[i] : at[i] + length[i]].tolist() for a in arrays])))
    block, length, at = block[order], length[order], at[order]
    opens = np.flatnonzero(np.diff(block, prepend=-1))
    edges = pa.array(np.append(0, np.cumsum(np.add.reduceat(length, opens))).astype(np.int32))
    place = take_runs(at, length)
    blocks = [pa.ListArray.from_arrays(edges, pa.array(values[a][place].astype(np.int32))) for a in arrays]
    kept = [pa.array([v] * len(opens), held[0].column(c).type) for c, v in zip(SHARD, (source, shard))]
    whole = pa.RecordBatch.from_arrays([*kept, pa.array(block[opens]), *blocks], [*SHARD, "block_id", *arrays])
    for i in range(0, len(opens), BLOCKS_AT_ONCE):
        yield whole.slice(i, BLOCKS_AT_ONCE)


def draw_sources(numbers: DataFrame, sources: list[MixtureSource], seed: int, workers: int = 1) -> DataFrame:
    """(worker, draw, seed, source): a weighted draw of each worker for every number ``draw``.

    Worker ``w`` draws with ``seed + w``. A draw depends on its seed and number only.
    """
    edges, total = [], 0.0
    for s in validate_mixture(sources):
        total += s.weight
        edges.append((s.name, total))
    draws = numbers.select(
        F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("worker"), "draw"
    ).withColumn("seed", F.col("worker") + F.lit(seed))
    point = uniform(F.col("seed"), "source", F.col("draw")) * F.lit(total)
    pick = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        pick = F.when(point < edge, F.lit(name)).otherwise(pick)
    return draws.withColumn("source", pick)


def source_draws(spark: SparkSession, sources: list[MixtureSource], n: int, seed: int, workers: int = 1) -> DataFrame:
    """The first ``n`` draws of ``draw_sources``."""
    return draw_sources(spark.range(n).select(F.col("id").alias("draw")), sources, seed, workers)


def usable_shards(manifest: DataFrame, seq_len: int, names: list[str]) -> DataFrame:
    """Shards long enough for a window, laid end to end per source.

    Adds (lo, hi): the token interval of the shard in its source, and (total, width): all
    tokens of the source and the mean length of a shard.
    """
    usable = manifest.where(F.col("num_tokens") > seq_len + 1)
    found = {r.source for r in usable.where(F.col("source").isin(names)).select("source").distinct().collect()}
    for name in names:
        if name not in found:
            raise ValueError(f"{name} has no shard long enough for seq_len={seq_len}")
    totals = usable.groupBy("source").agg(
        F.sum("num_tokens").alias("total"), F.ceil(F.sum("num_tokens") / F.count("*")).alias("width")
    )
    placed = with_sum_before(usable.select(*SHARD, "num_tokens"), "source", "shard_id", "num_tokens", "lo")
    return placed.withColumn("hi", F.col("lo") + F.col("num_tokens")).join(totals, "source")


def _scaled(share: Column, size: Column) -> Column:
    return F.least(F.floor(share * size), size - 1)


def window_plan(draws: DataFrame, shards: DataFrame, seq_len: int) -> DataFrame:
    """Add (shard_id, start): a shard by its share of tokens and a uniform start in it.

    A draw picks a token of its source; shards are matched through intervals of mean shard
    length, an equi-join that spreads the draws evenly. The last possible start is not drawn.
    """
    totals = shards.select("source", "total", "width").distinct()
    placed = (
        draws.join(F.broadcast(totals), "source")  # one row per source of the mixture
        .withColumn("token", _scaled(uniform(F.col("seed"), "shard", F.col("draw"), F.col("attempt")), F.col("total")))
        .withColumn("slot", F.floor(F.col("token") / F.col("width")))
        .drop("total", "width")
    )
    slots = F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))
    slotted = shards.select(*SHARD, "num_tokens", "lo", "hi", F.explode(slots).alias("slot"))
    matched = placed.join(slotted, ["source", "slot"]).where((F.col("lo") <= F.col("token")) & (F.col("token") < F.col("hi")))
    start = _scaled(uniform(F.col("seed"), "start", F.col("draw"), F.col("attempt")), F.col("num_tokens") - (seq_len + 1))
    return matched.withColumn("start", start).select("worker", "draw", "seed", "attempt", *SHARD, "start")


def cut_windows(plan: DataFrame, blocks: DataFrame | Fetch, seq_len: int, block_size: int, targets: str = "ids") -> DataFrame:
    """Add (x, y): ``seq_len`` tokens from ``start`` and the ``targets`` one place later.

    One equi-join: ``blocks`` overlap by ``seq_len`` tokens, so each window lies in one block. Instead of
    blocks there can be a function of (plan, seq_len, targets) that fetches the windows' tokens.
    """
    if not isinstance(blocks, DataFrame):
        return blocks(plan, seq_len, targets)
    size = F.lit(block_size).cast("bigint")
    at = plan.withColumn("block_id", F.floor(F.col("start") / size))
    skip = (F.col("start") - F.col("block_id") * size).cast("int")
    joined = at.join(blocks, [*SHARD, "block_id"])
    x, y = F.slice("ids", skip + 1, seq_len), F.slice(targets, skip + 2, seq_len)
    whole = F.when(F.size(y) == seq_len, y).otherwise(F.raise_error(F.lit("blocks overlap by less than seq_len")))
    return joined.select("worker", "draw", "seed", "attempt", *SHARD, "start", x.alias("x"), whole.alias("y"))


def pretrain_windows(draws: DataFrame, manifest: DataFrame, blocks: DataFrame | Fetch, names: list[str], seq_len: int, block_size: int) -> DataFrame:
    plan = window_plan(draws.withColumn("attempt", F.lit(0)), usable_shards(manifest, seq_len, names), seq_len)
    return cut_windows(plan, blocks, seq_len, block_size)


def supervised_places(rows: DataFrame) -> DataFrame:
    """(source, shard_id, slot, mask, next) of rows (source, shard_id, tok_start, labels): where supervised tokens are.

    A slot is SLOT tokens of a shard; bit i of ``mask`` stands for its i-th one, and ``next`` is the first supervised place behind
    the slot. Slots behind the last supervised token have no row. So one look-up tells the first supervised place from any place on.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("labels")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = lists.flatten().to_numpy(zero_copy_only=False) != MASKED
            row, place = row[hit], (batch.column("tok_start").to_numpy()[row] + offset)[hit]
            opens = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place // SLOT, prepend=-1) != 0))
            masks = np.bitwise_or.reduceat(np.int64(1) << (place % SLOT), opens) if len(opens) else np.zeros(0, np.int64)
            at = pa.array(row[opens])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in SHARD], pa.array(place[opens] // SLOT), pa.array(masks)], [*SHARD, "slot", "mask"])

    packed = rows.where(F.size("labels") > 0).select(*SHARD, "tok_start", "labels")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.select(*SHARD).schema)
    masks = packed.mapInArrow(pack, f"{schema}, slot bigint, mask bigint").groupBy(*SHARD, "slot").agg(F.bit_or("mask").alias("mask"))
    shard = Window.partitionBy(*SHARD).orderBy("slot")  # a shard has a bounded number of tokens
    first = F.col("slot") * SLOT + _lowest_bit(F.col("mask"))
    chained = masks.select("*", first.alias("first")).withColumns({
        "after": F.lead("slot").over(shard), "next": F.lead("first").over(shard), "before": F.lag("slot").over(shard)})
    # Empty slots up to the next filled one have its first place; so have those before the first filled one.
    run = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    none = F.lit(0).cast("bigint")
    own = F.array(F.struct(F.col("slot").alias("slot"), F.col("mask").alias("mask"), F.col("next").alias("next")))
    behind = F.transform(run(F.col("slot") + 1, F.coalesce("after", "slot") - 1), lambda s: F.struct(s.alias("slot"), none.alias("mask"), F.col("next").alias("next")))
    ahead = F.transform(F.when(F.col("before").isNull(), run(none, F.col("slot") - 1)).otherwise(F.array().cast("array<bigint>")), lambda s: F.struct(s.alias("slot"), none.alias("mask"), F.col("first").alias("next")))
    return chained.select(*SHARD, F.explode(F.concat(ahead, own, behind)).alias("s")).select(*SHARD, "s.*")


def _lowest_bit(mask: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def _with_target(plan: DataFrame, places: DataFrame, seq_len: int) -> DataFrame:
    """The planned windows that have a supervised token among their targets."""
    begin = F.col("start") + 1
    slotted = plan.withColumn("slot", F.floor(begin / F.lit(SLOT)))
    # Shifting by a power of two in place of bits: the distance is a column.
    left = F.floor(F.col("mask") / F.pow(F.lit(2.0), begin % SLOT)).cast("bigint")
    first = F.when(left != 0, begin + _lowest_bit(left)).otherwise(F.col("next"))
    return slotted.join(places, [*SHARD, "slot"]).where(first <= F.col("start") + seq_len).select(*plan.columns)


def supervised_windows(draws: DataFrame, manifest: DataFrame, blocks: DataFrame | Fetch, names: list[str], seq_len: int, block_size: int) -> DataFrame:
    """Windows with at least one supervised target; shard and start are drawn again until one is found.

    Attempts are tested by the places of supervised tokens alone, and one window is cut for each draw. Later attempts are only
    made for draws that are still open, more of them at a time. A draw without a window after ``MAX_ATTEMPTS`` attempts raises.
    """
    shards = usable_shards(manifest, seq_len, names)
    if isinstance(blocks, DataFrame):
        places = supervised_places(blocks.withColumn("tok_start", F.col("block_id") * block_size))
        places = materialise(places, "supervised-places")
    else:
        places = blocks.places()
    pending, filled, first = draws, [], 0
    for stop in (1, 8, MAX_ATTEMPTS):
        tries = pending.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(stop - 1))))
        good = _with_target(window_plan(tries, shards, seq_len), places, seq_len)
        if stop - first > 1:  # of several tries the first one
            good = good.groupBy("worker", "draw").agg(F.min(F.struct("attempt", "seed", *SHARD, "start")).alias("w")).select("worker", "draw", "w.*")
        filled.append(materialise(good.select("worker", "draw", "seed", "attempt", *SHARD, "start"), "window-plan"))
        # Draws are made from their number, so open ones are found again and not stored.
        pending = pending.join(filled[-1], ["worker", "draw"], "left_anti")
        if pending.isEmpty():
            break
        first = stop
    else:
        raise RuntimeError(f"no supervised window after {MAX_ATTEMPTS} attempts")
    return cut_windows(reduce(DataFrame.unionByName, filled), blocks, seq_len, block_size, "labels")


def batches(windows: DataFrame, batch_size: int, accumulate: int = 1) -> DataFrame:
    """Add (batch_id, step): consecutive draws of a worker, ``accumulate`` batches per step."""
    batch = F.floor(F.col("draw") / batch_size)
    return windows.withColumn("batch_id", batch).withColumn("step", F.floor(batch / accumulate))


def token_accounting(windows: DataFrame, batch_size: int, seq_len: int, accumulate: int = 1) -> DataFrame:
    """(worker, step, windows, tokens_seen) per step."""
    per_step = batch_size * seq_len * accumulate
    steps = batches(windows, batch_size, accumulate).groupBy("worker", "step").agg(F.count("*").alias("windows"))
    return steps.withColumn("tokens_seen", (F.col("step") + 1) * per_step)


# Seed offsets of the three sample sets.
SAMPLE_SETS = {"train": 0, "train_eval": 10_000, "eval": 20_000}


def mixture_report(manifest: DataFrame, sources: list[MixtureSource]) -> DataFrame:
    """(source, weight, num_shards, num_tokens, num_docs)."""
    spark = manifest.sparkSession
    specs = spark.createDataFrame([(s.name, float(s.weight)) for s in sources], "source string, weight double")
    totals = manifest.groupBy("source").agg(
        F.count("*").alias("num_shards"), F.sum("num_tokens").alias("num_tokens"), F.sum("num_docs").alias("num_docs")
    )
    return totals.join(F.broadcast(specs), "source").select("source", "weight", "num_shards", "num_tokens", "num_docs")
