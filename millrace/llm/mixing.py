"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of its documents in md5 order, gone through up to ``MAX_PASSES`` times
and cut into blocks of a fixed number of words. A source's quota is the blocks that its target
covers. A tree over the output shards splits the vector of quotas: each node hands its left
half of the shards a draw without replacement from its blocks, so the leaves add up to the
quotas exactly. Leaves take disjoint runs of the source's blocks, and every shard
is shuffled on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
MAX_PASSES = 2
PLACES = 4096  # buckets of md5 order in each source
MOST_BLOCKS = 400_000_000  # numpy draws from fewer than 10**9; blocks grow beyond this many
TOP = 10  # levels of the tree that one task opens; each node below is opened by a task of its own


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code-point order, null last. ``share``: size of the mix
    over the size of all sources. ``max_sources`` bounds the quota vectors, which are broadcast."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    block_words: int = 2048
    shard_blocks: int = 512
    seed: int = 7
    max_sources: int = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """(source, rank, source_size, target, quota_words) of each source.

    Targets are shares by weight, but at most MAX_PASSES times the source's size; what is cut off
    is shared anew among the others. That ends where one level times the weight, or the limit if
    lower, gives all targets, so it is found in one ordered pass.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = per.count()
    if found > params.max_sources:
        raise ValueError(f"{found} sources; MixParams.max_sources is {params.max_sources}")
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("rank", F.row_number().over(ordered) - 1)
    weights = F.array(*[F.lit(int(w)) for w in params.weights])
    per = per.withColumn("weight", F.get(weights, F.col("rank") % len(params.weights)).cast("bigint"))
    per = per.withColumn("most", MAX_PASSES * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(params.share))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = total - F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double")
    weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", rest / weight)
    # The level is that of the first source that it does not fill.
    open_level = F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())
    target = F.least(F.col("most").cast("double"), F.coalesce(open_level["level"] * F.col("weight"), F.col("most").cast("double")))
    return per.select("source", "rank", "source_size", target.alias("target"), F.floor(target).cast("bigint").alias("quota_words"))


def split_node(counts: np.ndarray, seed: int, level: int, node: int) -> np.ndarray:
    """Blocks of each source for the left half of a node's shards: half of all, drawn without replacement."""
    rng = np.random.Generator(np.random.PCG64([seed, level, node]))
    return rng.multivariate_hypergeometric(counts, int(counts.sum()) // 2, method="marginals")


def open_tree(counts: np.ndarray, seed: int, level: int, node: int, to: int):
    """(node, counts) at level ``to`` below a node."""
    if level == to:
        yield node, counts
        return
    left = split_node(counts, seed, level, node)
    yield from open_tree(left, seed, level + 1, 2 * node, to)
    yield from open_tree(counts - left, seed, level + 1, 2 * node + 1, to)


def _opener(seed: int, start: int, to: int):
    def run(batches):
        for batch in batches:
            for node, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(open_tree(np.array(counts, np.int64), seed, start, node, to))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in found], pa.int64()), pa.array([c.tolist() for _, c in found], pa.list_(pa.int64()))], ["shard", "counts"])

    return run


def shard_quotas(targets: DataFrame, block: int, params: MixParams) -> DataFrame:
    """(shard, rank, first, n): the run of a source's blocks that each shard takes."""
    blocks = F.ceil(F.col("quota_words") / F.lit(block)).cast("bigint")
    root = targets.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", blocks.alias("n")))), lambda x: x["n"]).alias("counts"))
    total = root.select(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).first()[0] or 0
    depth = max(0, int(np.ceil(np.log2(max(1, total / params.shard_blocks)))))
    top = min(depth, TOP)
    nodes = root.select(F.lit(0).cast("bigint").alias("shard"), "counts")
    nodes = nodes.mapInArrow(_opener(params.seed, 0, top), "shard bigint, counts array<bigint>")
    if depth > top:
        nodes = nodes.repartition(2**top, "shard").mapInArrow(_opener(params.seed, top, depth), "shard bigint, counts array<bigint>")
    runs = materialise(nodes.select("shard", F.posexplode("counts").alias("rank", "n")), "shard-quotas")
    # Runs lie one after the other by shard: sums of groups of shards first, then within a group.
    group = F.shiftright("shard", TOP)
    sums = runs.groupBy("rank", group.alias("group")).agg(F.sum("n").alias("sum"))
    earlier = lambda col, w: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("rank", "group", earlier("sum", Window.partitionBy("rank").orderBy("group")).alias("offset"))
    runs = runs.withColumn("group", group).join(offsets, ["rank", "group"])
    first = F.col("offset") + earlier("n", Window.partitionBy("rank", "group").orderBy("shard"))
    return runs.select("shard", "rank", first.alias("first"), "n").where("n > 0")


def mix(docs: DataFrame, params: MixParams = MixParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes: a row for each row of ``docs`` (doc_id, text, source) with doc_id, source, size
    (words), source_size, target (words of its source) and ``takes``, an array of (pass, shard, n_words,
    key): the document's first n_words words go to that shard, placed by key.

    Documents are taken whole, but for the one of each source at which its target ends. Null
    and wordless texts have size 0 and are never taken; a null source is a source of its own; equal
    rows are taken as separate documents, and an empty table gives no rows. Documents without an id stand in the order of
    their texts' hashes in place of the ids'. ``keep`` names further columns to hand on; others are ignored.
    """
    mark = F.xxhash64("text")
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), mark.cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(params.seed), named))
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), mark.alias("mark"), *[F.col(c).alias(f"keep_{c}") for c in keep]), "sizes")
    targets = materialise(source_targets(sizes, params), "targets")
    words = targets.agg(F.sum("quota_words")).first()[0] or 0
    block = max(params.block_words, -(-words // MOST_BLOCKS))
    quotas = shard_quotas(targets, block, params)

    # Start of each document in its source's stream; max_sources bounds this broadcast.
    bounded = F.broadcast(targets)
    rows = sizes.join(bounded.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("place", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    per = rows.groupBy("rank", "place").agg(F.sum("size").alias("sum"))
    earlier = lambda col, w: F.coalesce(F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("rank", "place", earlier("sum", Window.partitionBy("rank").orderBy("place")).alias("offset"))
    within = Window.partitionBy("rank", "place").orderBy("key", "doc_id", "size", "mark")
    rows = rows.join(offsets, ["rank", "place"]).withColumn("start", F.col("offset") + earlier("size", within))

    for n in range(MAX_PASSES):
        at = F.col("start") + n * F.col("source_size")
        count = F.greatest(F.lit(0), F.least("size", F.col("quota_words") - at)).cast("bigint")
        rows = rows.withColumn(f"n_{n}", count)
        # Places below 0 hold what is not taken; they meet no slot and spread like the rest.
        rows = rows.withColumn(f"slot_{n}", F.when(count > 0, F.floor(at / F.lit(block))).otherwise(-1 - F.col("place")).cast("bigint"))
    slots = materialise(quotas.select("shard", "rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")), "slots")
    takes = []
    for n in range(MAX_PASSES):
        place = slots.select("rank", F.col("slot").alias(f"slot_{n}"), F.col("shard").alias(f"shard_{n}"))
        rows = rows.join(place, ["rank", f"slot_{n}"], "left")
        shuffled = F.md5(F.concat_ws(":", "key", F.lit(n), F.col(f"shard_{n}").cast("string")))
        takes.append(F.struct(F.lit(n).alias("pass"), F.col(f"shard_{n}").alias("shard"), F.col(f"n_{n}").alias("n_words"), shuffled.alias("key")))
    takes = F.filter(F.array(*takes), lambda t: t["shard"].isNotNull())
    return rows.select("doc_id", "source", "size", "source_size", "target", takes.alias("takes"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: each take as a row with the columns of ``docs``, a text of which only some words are taken cut
    to these, joined by one space, n_chars to match, and pass, n_words, shard and position (from 0, shuffled within the shard).

    ``docs`` has doc_id, text, source and n_chars (columns of the added names are replaced, any others are kept). Each row is a document of its own,
    also without an id or with that of another: rows are written once with a number, by which they meet their takes.
    Documents of which nothing is taken are not in it.
    """
    own = docs.columns
    # Under names of their own, the caller's columns can't meet the ones made here.
    inner = [c if c in ("doc_id", "text", "source") else f"_kept_{i}" for i, c in enumerate(own)]
    rows = materialise(docs.toDF(*inner).withColumn("_row", F.monotonically_increasing_id()).withColumn("_mark", F.xxhash64("text")), "mixed-rows")
    plan = mix(rows, params, ("_row", "_mark")).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_taken"), "_mark", F.explode("takes").alias("_take"))
    place = F.row_number().over(Window.partitionBy("_take.shard").orderBy("_take.key", "_id", "_mark", "_taken")) - 1
    plan = plan.withColumn("_position", place.cast("bigint")).drop("_id", "_mark")  # shards hold a bounded number of blocks
    rows = rows.join(plan, F.col("_row") == F.col("_taken"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_take.n_words").cast("int")), " ")
    whole = F.col("_take.n_words") >= word_count(F.col("text"))
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(head))
    named = {c: F.col(k) for c, k in zip(own, inner, strict=True)} | {"n_chars": F.length("text").cast("bigint")}
    named |= {"pass": F.col("_take.pass"), "n_words": F.col("_take.n_words"), "shard": F.col("_take.shard"), "position": F.col("_position")}
    return rows.select(*[column.alias(name) for name, column in named.items()])
