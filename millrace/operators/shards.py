"""Order-exact next-fit sharding without a sequential pass.

A shard takes documents in order while it stays within ``limit`` tokens; a document that
does not fit opens the next shard, and a longer document has a shard of its own. Only
(ord, n) is needed, so that is all that moves. Documents are identified by ``base``, the
number of tokens before them. The first document that does not fit after a shard opened at
document ``i`` is the first ``j`` with ``end(j) > max(base(i) + limit, end(i))``.

1. Range-split (ord, n) into chunks of a bounded number of documents, write them, and take
   the token total of each chunk (at most ``MAX_CHUNKS`` rows).
2. In each chunk find, for every document that may be the first to open a shard there, the
   last shard it leads to within the chunk. Look up where the next one opens, in the chunk
   that holds that token position.
3. Double these jumps by self-joins until the opening document of every chunk is known.
4. Walk each chunk once from its opening document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise

CHUNK_DOCS = 1 << 20
MAX_CHUNKS = 1 << 16
STARTS_ON_DRIVER = 1 << 20


@dataclass(frozen=True)
class ShardPlan:
    chunks: DataFrame  # (chunk, ord, n)
    pieces: DataFrame  # (shard_id, first_ord, base, num_docs, num_tokens): a shard's part of a chunk
    limit: int
    layout: _Layout

    def manifest(self) -> DataFrame:
        """(shard_id, first_ord, base, num_docs, num_tokens). No documents give one empty shard."""
        shards = self.pieces.groupBy("shard_id").agg(
            F.min("first_ord").alias("first_ord"),
            F.min("base").alias("base"),
            F.sum("num_docs").cast("bigint").alias("num_docs"),
            F.sum("num_tokens").cast("bigint").alias("num_tokens"),
        )
        if self.layout.ends.size:
            return shards
        empty = "0 AS shard_id, CAST(NULL AS BIGINT) AS first_ord, 0L AS base, 0L AS num_docs, 0L AS num_tokens"
        return self.pieces.sparkSession.range(1).selectExpr(*empty.split(", "))

    def documents(self) -> DataFrame:
        """(ord, n, shard_id, tok_start, tok_end): offsets of every document in its shard."""
        layout, limit = self.layout, self.limit

        def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            chunk = int(key[0])
            pdf = pdf.sort_values("ord", ignore_index=True)
            end = layout.begin(chunk) + np.cumsum(pdf["n"].to_numpy())
            base = end - pdf["n"].to_numpy()
            opened = _walk(base, end, layout.opening(chunk), limit)
            nth = np.searchsorted(opened, np.arange(len(pdf)), side="right")
            shard_base = np.concatenate([[layout.open_base[chunk]], base[opened]])[nth]
            return pd.DataFrame({
                "ord": pdf["ord"], "n": pdf["n"], "shard_id": layout.shards_before[chunk] - 1 + nth,
                "tok_start": base - shard_base, "tok_end": end - shard_base,
            })

        schema = "ord bigint, n bigint, shard_id int, tok_start bigint, tok_end bigint"
        return self.chunks.groupBy("chunk").applyInPandas(place, schema)

    def attach(self, rows: DataFrame) -> DataFrame:
        """Add ``shard_id`` to rows with ``ord``, leaving them where they are.

        The first ``ord`` of each shard is a sorted list; a row belongs to the last one not
        above its own. Beyond ``STARTS_ON_DRIVER`` shards the rows are joined on ``ord``.
        """
        shards = self.manifest()
        if shards.count() > STARTS_ON_DRIVER:
            return rows.join(self.documents().select("ord", "shard_id"), "ord")
        starts = np.sort(np.array([r.first_ord for r in shards.select("first_ord").collect()], np.int64))
        shared = rows.sparkSession.sparkContext.broadcast(starts)

        @F.pandas_udf("int")
        def shard_of(ord_values: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(shared.value, ord_values.to_numpy(), side="right") - 1)

        return rows.withColumn("shard_id", shard_of("ord"))


@dataclass
class _Layout:
    """Per chunk, in order: where its tokens end and which document opens a shard first."""

    ends: np.ndarray
    openings: dict[int, int]
    shards_before: np.ndarray
    open_base: np.ndarray

    def begin(self, chunk: int) -> int:
        return int(self.ends[chunk - 1]) if chunk else 0

    def opening(self, chunk: int) -> int | None:
        return self.openings.get(chunk)


def _next_open(base: np.ndarray, end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a chunk: the token position its shard may reach, and who opens next.

    The second is an index into the chunk, or its length if that document lies beyond it.
    """
    reach = np.maximum(base + limit, end)
    return reach, np.searchsorted(end, reach, side="right")


def _walk(base: np.ndarray, end: np.ndarray, opening: int | None, limit: int) -> np.ndarray:
    """Indexes of the documents that open shards, from the one with ``base == opening``."""
    if opening is None:
        return np.zeros(0, np.int64)
    _, following = _next_open(base, end, limit)
    at = int(np.searchsorted(base, opening))
    opened = []
    while at < len(base):
        opened.append(at)
        at = int(following[at])
    return np.array(opened, np.int64)


def _chunked(lengths: DataFrame, chunk_docs: int) -> DataFrame:
    # Filtered after the write: a filter on the length of an encoded text would encode it twice.
    slim = materialise(lengths.select("ord", F.col("n").cast("bigint").alias("n")), "lengths").where("n > 0")
    docs = slim.count()
    count = max(1, math.ceil(docs / max(chunk_docs, math.ceil(docs / MAX_CHUNKS))))
    if count == 1:
        return slim.withColumn("chunk", F.lit(0))
    ranged = slim.repartitionByRange(count, "ord").withColumn("chunk", F.spark_partition_id())
    return materialise(ranged, "length-chunks")


def plan_shards(lengths: DataFrame, limit: int, chunk_docs: int = CHUNK_DOCS) -> ShardPlan:
    """Next-fit over (ord, n) in ``ord`` order; documents without tokens are left out."""
    if limit < 1:
        raise ValueError(f"shard limit must be positive: {limit}")
    chunks = _chunked(lengths, chunk_docs)
    totals = chunks.groupBy("chunk").agg(F.sum("n").alias("tokens")).orderBy("chunk").collect()
    # Range splitting may leave a chunk empty; give the others consecutive places.
    size = max([r.chunk for r in totals], default=-1) + 1
    tokens = np.zeros(size, np.int64)
    for r in totals:
        tokens[r.chunk] = r.tokens
    ends = np.cumsum(tokens)
    openings = {0: 0} if size == 1 else _openings(chunks, ends, limit) if size else {}
    layout = _Layout(ends, openings, np.zeros(size, np.int64), np.zeros(size, np.int64))

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(key[0])
        pdf = pdf.sort_values("ord", ignore_index=True)
        end = layout.begin(chunk) + np.cumsum(pdf["n"].to_numpy())
        base = end - pdf["n"].to_numpy()
        opened = _walk(base, end, layout.opening(chunk), limit)
        first = opened if len(opened) and opened[0] == 0 else np.concatenate([[0], opened]).astype(np.int64)
        stop = np.append(first[1:], len(pdf))
        return pd.DataFrame({
            "chunk": chunk, "nth": np.searchsorted(opened, first, side="right"),
            "first_ord": pdf["ord"].to_numpy()[first], "base": base[first],
            "num_docs": stop - first, "num_tokens": end[stop - 1] - base[first],
        })

    schema = "chunk int, nth int, first_ord bigint, base bigint, num_docs bigint, num_tokens bigint"
    pieces = materialise(chunks.groupBy("chunk").applyInPandas(cut, schema), "shard-pieces")
    opened = pieces.where("nth > 0").groupBy("chunk").agg(F.count("*").alias("c"), F.max("base").alias("b")).collect()
    counts, last = np.zeros(size, np.int64), np.full(size, -1)
    for r in opened:
        counts[r.chunk], last[r.chunk] = r.c, r.b
    layout.shards_before = np.cumsum(counts) - counts
    layout.open_base = np.concatenate([[0], np.maximum.accumulate(last)[:-1]]) if size else last

    before = chunks.sparkSession.sparkContext.broadcast(layout.shards_before)

    @F.pandas_udf("int")
    def shard_id(chunk: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(before.value[chunk.to_numpy()] - 1 + nth.to_numpy())

    numbered = pieces.withColumn("shard_id", shard_id("chunk", "nth")).drop("chunk", "nth")
    return ShardPlan(chunks, numbered, limit, layout)


def _openings(chunks: DataFrame, ends: np.ndarray, limit: int) -> dict[int, int]:
    """{chunk: base of the first document that opens a shard in it}."""

    def leave(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(key[0])
        begin = int(ends[chunk - 1]) if chunk else 0
        pdf = pdf.sort_values("ord", ignore_index=True)
        end = begin + np.cumsum(pdf["n"].to_numpy())
        base = end - pdf["n"].to_numpy()
        reach, following = _next_open(base, end, limit)
        here = np.arange(len(base))
        last = np.where(following < len(base), following, here)
        while not np.array_equal(last[last], last):
            last = last[last]
        entry = base <= begin + limit if chunk else base == 0
        return pd.DataFrame({
            "pos": base[entry], "chunk": chunk, "reach": reach[last][entry],
            "to_chunk": np.searchsorted(ends, reach[last][entry], side="right"),
        })

    exits = materialise(
        chunks.groupBy("chunk").applyInPandas(leave, "pos bigint, chunk int, reach bigint, to_chunk int"), "shard-exits"
    ).where(F.col("to_chunk") < len(ends))

    # A chunk is read once per chunk that reaches into it. Both run in order, so there are at
    # most twice as many such pairs as chunks, and every group holds two bounded chunks.
    wanted = exits.select("chunk", "to_chunk", "reach").distinct()
    pairs = wanted.select("to_chunk", F.col("chunk").alias("from_chunk")).distinct()
    targets = chunks.withColumnRenamed("chunk", "to_chunk").join(pairs, "to_chunk")

    def look_up(key: tuple, docs: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        chunk = int(key[0])
        begin = int(ends[chunk - 1]) if chunk else 0
        n = docs.sort_values("ord")["n"].to_numpy()
        end = begin + np.cumsum(n)
        at = np.searchsorted(end, reached["reach"].to_numpy(), side="right")
        return pd.DataFrame({"reach": reached["reach"], "dst": (end - n)[at]})

    found = (
        targets.groupBy("to_chunk", "from_chunk")
        .cogroup(wanted.withColumnRenamed("chunk", "from_chunk").groupBy("to_chunk", "from_chunk"))
        .applyInPandas(look_up, "reach bigint, dst bigint")
        .distinct()
    )
    jumps = materialise(exits.join(found, "reach").select(F.col("pos").alias("src"), "dst"), "shard-jumps")
    spark = chunks.sparkSession
    seen, reached = 1, spark.range(1).select(F.lit(0).cast("bigint").alias("pos"))
    while True:
        onward = reached.join(jumps, reached.pos == jumps.src).select(F.col("dst").alias("pos"))
        reached = materialise(reached.union(onward).distinct(), "shard-openings")
        count = reached.count()
        if count == seen:
            break
        seen = count
        second = jumps.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
        jumps = materialise(jumps.join(second, jumps.dst == second.mid).select("src", F.col("far").alias("dst")), "shard-jumps")
    # One opening per chunk at most.
    return {int(np.searchsorted(ends, r.pos, side="right")): r.pos for r in reached.collect()}


def dataset_manifest(shards: DataFrame, dtype: str | None = None) -> DataFrame:
    """One row of totals over a shard manifest."""
    totals = shards.agg(
        F.count("*").alias("num_shards"),
        F.coalesce(F.sum("num_docs"), F.lit(0)).cast("bigint").alias("num_docs"),
        F.coalesce(F.sum("num_tokens"), F.lit(0)).cast("bigint").alias("num_tokens"),
    )
    return totals if dtype is None else totals.withColumn("dtype", F.lit(dtype))
