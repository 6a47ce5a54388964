"""Find passages of a benchmark in documents, with edits, by q-gram lemma filtering.

A passage of n characters with at most k edits shares at least n - q + 1 - k q of the item's q-grams, and
these lie on diagonals (place in the text minus place in the item) at most k apart. So shared q-grams are
counted in bands of diagonals that overlap by k; a band that reaches the bound gives a region of
the text, and a banded alignment decides whether the item really lies in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import mix64
from millrace.session import materialise

TABLE_BITS = 22
CHUNK = 1 << 20  # characters whose q-grams are looked up at once
_M = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class LeakParams:
    """``rate``: edits for each character of an item; q * rate must stay below 1. Items of which fewer than
    ``least_shared`` q-grams would have to be shared are too short for the filter and get a smaller edit
    budget, down to none. Items shorter than q have no q-gram and are looked up whole; those of fewer than ``shortest``
    characters stand in almost any text and are left out. ``block_chars`` bounds the
    benchmark text that is broadcast at once: a larger benchmark is gone through in blocks."""

    q: int = 12
    rate: float = 0.05
    least_shared: int = 8
    shortest: int = 3
    block_chars: int = 8_000_000


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters with A-Z lower-cased and each run of white space as one space, offsets)."""
    flat = [" ".join(t.split()) for t in texts]
    points = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in flat])])


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(points) - q + 1, np.uint64)
    wide = points.astype(np.uint64)
    # Doubling: runs of 1, 2, 4 … characters, put together by the binary digits of q.
    run, size, done = wide, 1, 0
    while True:
        if q & size:
            out = out * np.uint64(_M * (2 * size + 1) % 2**64) + run[done : done + len(out)]
            done += size
        size *= 2
        if size > q:
            return mix64(out)
        half = size // 2
        run = run[: len(run) - half] * np.uint64((_M + 2 * size) % 2**64) + run[half:]


def budget(n: int, params: LeakParams) -> int:
    """Edits allowed for an item of n characters."""
    return max(0, min(math.floor(n * params.rate), (n - params.q + 1 - params.least_shared) // params.q))


class Benchmark:
    """The items of one block and where their q-grams are."""

    def __init__(self, items: list[tuple[int, str]], params: LeakParams):
        self.params = params
        self.ids = np.array([i for i, _ in items], np.int64)
        points, offsets = code_points([t for _, t in items])
        self.texts = [points[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        hashes, item, place = [], [], []
        for number, text in enumerate(self.texts):
            found = gram_hashes(text, params.q)
            hashes.append(found)
            item.append(np.full(len(found), number))
            place.append(np.arange(len(found)))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.budgets = np.array([budget(len(t), params) for t in self.texts], np.int64)
        self.bound = np.array([max(1, len(t) - params.q + 1 - k * params.q) for t, k in zip(self.texts, self.budgets, strict=True)], np.int64)
        self.reach = int(max((len(t) + 2 * k for t, k in zip(self.texts, self.budgets.tolist(), strict=True)), default=0)) + params.q
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(t) for t in self.texts if params.shortest <= len(t) < params.q}):
            numbers = np.array([i for i, t in enumerate(self.texts) if len(t) == n])
            hashes = np.concatenate([gram_hashes(self.texts[i], n) for i in numbers])
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], numbers[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - TABLE_BITS)] = True

    def regions(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(item, diagonal) of the bands in which enough q-grams are shared; each reaches from its diagonal to
        2 k beyond it. Items without a q-gram come with the first place they stand at.

        A long text is gone through in pieces of CHUNK characters, which overlap by what a band takes of the text. So what is
        unfolded at once is bounded, and every band lies in one piece.
        """
        found: dict[tuple[int, int], None] = {}
        for start in range(0, max(1, len(points)), CHUNK):
            found |= dict.fromkeys(self._bands(points[start : start + CHUNK + self.reach], start))
        return [*self._short_items(points), *found]

    def _short_items(self, points: np.ndarray) -> list[tuple[int, int]]:
        found = []
        for n, (hashes, numbers) in self.short.items():
            grams = gram_hashes(points, n)
            values, first = np.unique(grams, return_index=True)
            at = np.searchsorted(values, hashes)
            at[at == len(values)] = 0
            hit = values[at] == hashes if len(values) else np.zeros(len(hashes), bool)
            found += zip(numbers[hit].tolist(), first[at[hit]].tolist(), strict=True)
        return found

    def _bands(self, points: np.ndarray, start: int) -> list[tuple[int, int]]:
        grams = gram_hashes(points, self.params.q)
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - TABLE_BITS)])
        if not len(at):
            return []
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        counts = high - low
        at, low, counts = at[counts > 0], low[counts > 0], counts[counts > 0]
        if not len(at):
            return []
        entry = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        item = self.item[entry]
        diagonal = start + np.repeat(at, counts) - self.place[entry]
        width = self.budgets[item] + 1
        shift = np.int64(1) << np.int64(40)
        base = np.floor_divide(diagonal, width)
        # Each place in the item counts once in a band: repeats on other diagonals do not add up.
        keys = np.concatenate([item * shift + base + (1 << 39), item * shift + base - 1 + (1 << 39)])
        places = np.concatenate([self.place[entry]] * 2)
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        new = new_key | np.append(True, places[1:] != places[:-1])
        group = np.cumsum(new_key) - 1
        shared = np.bincount(group, new).astype(np.int64)
        keys = keys[new_key]
        item = keys >> 40
        good = shared >= self.bound[item]
        band = (keys & (shift - 1)) - (1 << 39)
        return [(int(i), int(b * (self.budgets[i] + 1))) for i, b in zip(item[good], band[good], strict=True)]

    def align(self, points: np.ndarray, item: int, diagonal: int) -> tuple[int, int] | None:
        """(edits, end) of the best alignment of the whole item in the band from ``diagonal``, if within its budget."""
        text, k = self.texts[item], int(self.budgets[item])
        return banded(text, points, diagonal, 2 * k + 1, k)


def banded(item: np.ndarray, points: np.ndarray, diagonal: int, width: int, k: int) -> tuple[int, int] | None:
    """Least edits that turn ``item`` into a stretch of ``points`` starting in the band, which drifts by up to k more."""
    n, lo = len(item), diagonal - k
    span = width + 2 * k
    padded = np.full(n + span, np.uint32(0xFFFFFFFF))
    a, b = max(0, lo), min(len(points), lo + n + span)
    if a < b:
        padded[a - lo : b - lo] = points[a:b]
    if k == 0 or span == 1:
        for d in range(span):
            if np.array_equal(padded[d : d + n], item):
                return 0, lo + d + n
        if k == 0:
            return None
    steps = np.arange(span)
    # Column d of row i stands for the text place lo + i + d; rows before the text have no start.
    cost = np.zeros(span, np.int64)
    cost[(lo + steps < 0) | (lo + steps > len(points))] = n + 1
    for i in range(n):
        change = cost + (padded[i : i + span] != item[i])
        skip = np.append(cost[1:] + 1, n + 1)
        best = np.minimum(change, skip)
        # Extra characters of the text: costs carried to the right, one for each step.
        cost = np.minimum.accumulate(best - steps) + steps
    end = int(np.argmin(cost))
    return (int(cost[end]), lo + n + end) if cost[end] <= k else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], params: LeakParams = LeakParams()) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``leaks``: (item_id, edits, end) for each item found in the whole text.

    ``end`` counts characters of the text with runs of white space as one. Of an item's places only that with
    the fewest edits is listed (then the first). Letter case A-Z and white space do not matter. Null and
    empty texts have no leaks, null ids and texts of the benchmark (item_id, text) are left out, repeated ids
    are separate texts of one item. Equal rows give equal results, an empty table gives none. Columns not in ``keep`` are ignored; a
    kept one can have any name but leaks. A text may be of any length.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    found_type = "array<struct<item_id:bigint,edits:bigint,end:bigint>>"
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // params.block_chars))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("end", pa.int64())]))

    at = keep.index("text") if "text" in keep else len(keep)

    def searcher(shared, carried: list[str], at: int):
        def run(batches):
            index = Benchmark(shared.value, params)
            for batch in batches:
                out = []
                for text in batch.column(at).to_pylist():
                    best: dict[int, tuple[int, int]] = {}
                    if text:
                        points, _ = code_points([text])
                        tried = set()
                        for item, diagonal in index.regions(points):
                            key = int(index.ids[item])
                            if best.get(key, (1, 0))[0] == 0 or (item, diagonal) in tried:
                                continue
                            tried.add((item, diagonal))
                            got = index.align(points, item, diagonal)
                            if got is not None and (key not in best or got < best[key]):
                                best[key] = got
                    out.append([{"item_id": i, "edits": e, "end": end} for i, (e, end) in sorted(best.items())])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(out, kind)], [*carried, "leaks"])

        return run

    # Under names of their own, the caller's columns can't meet the ones made here.
    inner = [f"_kept_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)], *[F.col("text").alias("_text")] * ("text" not in keep))
    carried = rows.columns
    part_of = lambda block: [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]  # noqa: E731  block_chars in expectation
    final = [F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)]
    if blocks == 1:
        schema = rows.schema.simpleString()[7:-1]
        return rows.mapInArrow(searcher(spark.sparkContext.broadcast(part_of(0)), carried, at), f"{schema}, leaks {found_type}").select(*final, "leaks")
    # One index at a time: what a block finds is written by row number, and small, and the rows are read again for the next block.
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "leak-rows")
    texts, found = rows.select("_row", F.col(carried[at]).alias("_text")), []
    for block in range(blocks):
        shared = spark.sparkContext.broadcast(part_of(block))
        some = texts.mapInArrow(searcher(shared, ["_row", "_text"], 1), f"_row bigint, _text string, leaks {found_type}")
        found.append(materialise(some.where(F.size("leaks") > 0).select("_row", "leaks"), "leaks-found"))
        shared.unpersist()
    each = reduce(DataFrame.unionByName, found).select("_row", F.explode("leaks").alias("x"))
    # The texts of one repeated id may lie in several blocks.
    best = each.groupBy("_row", "x.item_id").agg(F.min(F.struct("x.edits", "x.end")).alias("b"))
    leaks = best.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("item_id", "b.edits", "b.end"))).alias("leaks"))
    return rows.join(leaks, "_row", "left").select(*final, F.coalesce("leaks", F.array().cast(found_type)).alias("leaks"))
