"""Byte-level BPE training over the distinct words of a corpus, by changes of pair counts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from millrace.functions.byte_symbols import (
    BYTE_IDS,
    BYTE_SYMBOLS,
    FIRST_MERGE_ID,
    UNKNOWN,
    UNKNOWN_ID,
    byte_ids,
)
from millrace.functions.merging import NO_RANK, RankTable, merge_words, pair_keys, same_word
from millrace.functions.pretokens import char_classes, split_words
from millrace.session import materialise

CANDIDATES = 512  # pairs looked at in one round
POOL = 1 << 14  # pairs whose counts the driver keeps up to date
WORDS_PER_TASK = 20_000
ROUNDS_PER_WRITE = 12  # lineage is cut this often
MAX_VOCABULARY = 1 << 20


@dataclass(frozen=True)
class Merge:
    rank: int
    left: int
    right: int
    new_id: int
    count: int


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt) over a corpus; counts are combined before the shuffle, so hot words do not skew."""
    shared = documents.sparkSession.sparkContext.broadcast(char_classes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = split_words(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays(found.value_counts().flatten(), names=["word", "cnt"])

    counted = documents.select(F.col(text)).mapInArrow(count, "word string, cnt bigint")
    return counted.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def word_symbols(counts: DataFrame) -> DataFrame:
    """(ids, cnt): every distinct word of two bytes or more as byte ids."""
    symbols = counts.where(F.octet_length("word") > 1).select(byte_ids(F.col("word")).alias("ids"), "cnt")
    tasks = max(1, -(-counts.count() // WORDS_PER_TASK))
    return symbols.repartition(tasks)


def _symbols(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbol ids, word number of each)."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol ids, word number of each, count of each word) of one Arrow batch."""
    return *_symbols(batch.column("ids")), batch.column("cnt").to_numpy(zero_copy_only=False)


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(l, r, side, near, cnt) per batch: each pair with the symbol before (side 0) or after it.

    ``near`` is -1 at the end of a word, so either side alone counts every pair once.
    """
    for batch in batches:
        ids, word, cnt = _flat(batch)
        at = np.flatnonzero(same_word(word))
        before = np.where((at > 0) & (word[at - 1] == word[at]), ids[at - 1], -1)
        ahead = np.minimum(at + 2, len(ids) - 1)
        after = np.where((at + 2 < len(ids)) & (word[ahead] == word[at]), ids[ahead], -1)
        for side, near in ((0, before), (1, after)):
            spots = pa.table({"l": ids[at], "r": ids[at + 1], "near": near.astype(np.int32), "cnt": cnt[word[at]]})
            total = spots.group_by(["l", "r", "near"], use_threads=False).aggregate([("cnt", "sum")])
            sides = pa.array(np.full(total.num_rows, side, np.int32))
            for part in total.append_column("side", sides).select(["l", "r", "side", "near", "cnt_sum"]).to_batches():
                yield part.rename_columns(["l", "r", "side", "near", "cnt"])


SPOTS = "l int, r int, side int, near int, cnt bigint"


def pair_counts(symbols: DataFrame) -> DataFrame:
    """(l, r, cnt) of all adjacent pairs, weighted by word counts."""
    spots = symbols.mapInArrow(_spots, SPOTS).where("side = 0")
    return spots.groupBy("l", "r").agg(F.sum("cnt").alias("cnt"))


def _ranked_pairs(symbols: DataFrame) -> DataFrame:
    """(l, r, cnt, bound): ``bound`` limits the count of any pair that merging (l, r) can create.

    Such a pair joins (l, r) to the symbol before or after it, so the most frequent
    neighbour on either side bounds it.
    """
    # The batches are summed already; placed by pair, both aggregations need no other shuffle.
    spots = symbols.mapInArrow(_spots, SPOTS).repartition("l", "r")
    near = spots.groupBy("l", "r", "side", "near").agg(F.sum("cnt").alias("cnt"))
    return near.groupBy("l", "r").agg(
        F.sum(F.when(F.col("side") == 0, F.col("cnt")).otherwise(0)).alias("cnt"),
        F.coalesce(F.max(F.when(F.col("near") >= 0, F.col("cnt"))), F.lit(0)).alias("bound"),
    )


def _spots_of(ids: np.ndarray, word: np.ndarray, weight: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns l, r, side, near, cnt: every pair once with side -1, and those with a symbol of ``fresh`` by neighbour."""
    at = np.flatnonzero(same_word(word))
    l, r, cnt = ids[at], ids[at + 1], weight[word[at]]
    before = np.where((at > 0) & (word[at - 1] == word[at]), ids[at - 1], -1)
    ahead = np.minimum(at + 2, len(ids) - 1)
    after = np.where((at + 2 < len(ids)) & (word[ahead] == word[at]), ids[ahead], -1)
    new = np.isin(l, fresh) | np.isin(r, fresh)
    near = np.concatenate([np.full(len(at), -1), before[new], after[new]])
    side = np.repeat(np.array([-1, 0, 1]), [len(at), new.sum(), new.sum()])
    return np.concatenate([l, l[new], l[new]]), np.concatenate([r, r[new], r[new]]), side, near, np.concatenate([cnt, cnt[new], cnt[new]])


def _joined(symbols: DataFrame, chosen: list[tuple[int, int, int]]) -> DataFrame:
    """Apply merges (l, r, new id) to every word, all in one lookup; ``old`` is what a changed word was."""
    table = RankTable(chosen)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word, cnt = _flat(batch)
            changed = np.zeros(len(cnt), bool)
            changed[word[:-1][same_word(word) & (table.rank_of(pair_keys(ids)) != NO_RANK)]] = True
            keep = ~changed & (np.bincount(word, minlength=len(cnt)) > 1)
            same = batch.select(["ids", "cnt"]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*same.columns, pa.nulls(len(same), pa.list_(pa.int32()))], names=["ids", "cnt", "old"])
            if changed.any():
                was = batch.select(["ids", "cnt"]).filter(pa.array(changed))
                ids, word, _ = _flat(was)
                ids, word = merge_words(ids, word, table)
                ends = np.append(0, np.cumsum(np.bincount(word, minlength=len(was)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, was.column("cnt"), was.column("ids")], names=["ids", "cnt", "old"])

    return symbols.select("ids", "cnt").mapInArrow(join, "ids array<int>, cnt bigint, old array<int>")


def _changes(symbols: DataFrame, fresh: list[int], pool: np.ndarray, least: int) -> DataFrame:
    """(l, r, cnt, bound) by which the last merges changed the pairs in ``pool`` (sorted keys), and all new pairs of at least ``least``.

    Only words that contained a merged pair are unfolded, and only their differences are shuffled. A new pair stands
    in such words alone, so its count and the ``bound`` of what merging it can create are whole.
    """
    spark = symbols.sparkSession
    kept = spark.sparkContext.broadcast((np.array(sorted(fresh)), pool))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, pool = kept.value
        for batch in batches:
            cnt = batch.column("cnt").to_numpy(zero_copy_only=False)
            parts = [_spots_of(*_symbols(batch.column(name)), weight, fresh) for name, weight in (("old", -cnt), ("ids", cnt))]
            l, r, side, near, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            keys = l.astype(np.int64) << 32 | r
            at = np.searchsorted(pool, keys).clip(max=max(0, len(pool) - 1))
            wanted = np.isin(l, fresh) | np.isin(r, fresh) | (pool[at] == keys if len(pool) else False)
            spots = pa.table([pa.array(c[wanted].astype(t)) for c, t in ((l, "i4"), (r, "i4"), (side, "i4"), (near, "i4"), (n, "i8"))], ["l", "r", "side", "near", "cnt"])
            total = spots.group_by(["l", "r", "side", "near"], use_threads=False).aggregate([("cnt", "sum")])
            for part in total.select(["l", "r", "side", "near", "cnt_sum"]).to_batches():
                yield part.rename_columns(["l", "r", "side", "near", "cnt"])

    changed = symbols.where("old IS NOT NULL").select("ids", "cnt", "old").mapInArrow(differ, SPOTS).repartition("l", "r")
    near = changed.groupBy("l", "r", "side", "near").agg(F.sum("cnt").alias("cnt"))
    pairs = near.groupBy("l", "r").agg(
        F.sum(F.when(F.col("side") < 0, F.col("cnt"))).alias("cnt"),
        F.coalesce(F.max(F.when((F.col("side") >= 0) & (F.col("near") >= 0), F.col("cnt"))), F.lit(0)).alias("bound"),
        F.max("side").alias("side"),
    )
    is_new = F.col("side") >= 0
    return pairs.where((~is_new & (F.col("cnt") != 0)) | (is_new & (F.col("cnt") >= least))).select("l", "r", "cnt", "bound")


def _sure_prefix(pairs: list, room: int, known: dict[bytes, int], spelling: dict[int, bytes]) -> list[tuple]:
    """The leading pairs that one-at-a-time training would also pick next, in this order.

    Stops at the first pair whose count a chosen merge changes, or whose count does not
    exceed what a chosen merge may have created, or after a token that exists already.
    """
    chosen: list[tuple] = []
    bound = 0
    for row in pairs:
        touched = any(row.l == r or row.r == l for l, r, _, _ in chosen)
        if chosen and (touched or row.cnt <= bound):
            break
        token = spelling[row.l] + spelling[row.r]
        repeated = token in known
        chosen.append((row.l, row.r, row.cnt, token))
        bound = max(bound, row.bound)
        if not repeated:
            known[token] = len(known)
            spelling[known[token]] = token
            room -= 1
        if repeated or room <= 0:
            break
    return chosen


class _Pool:
    """The most frequent pairs, as far as they are known: (count, bound) of each, and the place where knowledge ends.

    A pair that is not new can only lose occurrences, and the most frequent neighbour on either side too. So whatever stands
    before ``end`` in the order (highest count, lowest ids) and isn't here has come about since, and ``update`` brings it.
    """

    def __init__(self, rows: list, size: int):
        self.pairs = {(r.l, r.r): (r.cnt, r.bound) for r in rows[:size] if r.cnt > 0}
        self.end = self._place((rows[size].l, rows[size].r), rows[size].cnt) if len(rows) > size else (0, 0, 0)

    @staticmethod
    def _place(pair: tuple[int, int], cnt: int) -> tuple[int, int, int]:
        return -cnt, *pair

    def least(self) -> int:
        """The count that a new pair needs to matter."""
        return max(1, -self.end[0])

    def keys(self) -> np.ndarray:
        return np.sort(np.array([l << 32 | r for l, r in self.pairs], np.int64))

    def top(self, n: int) -> list[Row]:
        best = heapq.nsmallest(n, ((self._place(p, c), b) for p, (c, b) in self.pairs.items()))
        return [Row(l=l, r=r, cnt=-cnt, bound=bound) for (cnt, l, r), bound in best]

    def update(self, changes: list[Row]) -> None:
        for row in changes:
            pair = (row.l, row.r)
            cnt, bound = self.pairs.get(pair, (0, row.bound))
            if cnt + row.cnt > 0 and self._place(pair, cnt + row.cnt) < self.end:
                self.pairs[pair] = (cnt + row.cnt, bound)
            else:
                self.pairs.pop(pair, None)

    def trim(self, size: int) -> None:
        """Forget the rarest pairs beyond ``size`` and let knowledge end there."""
        if len(self.pairs) > size:
            ordered = sorted(self.pairs, key=lambda p: self._place(p, self.pairs[p][0]))
            self.end = self._place(ordered[size], self.pairs[ordered[size]][0])
            for pair in ordered[size:]:
                del self.pairs[pair]


def train_bpe(counts: DataFrame, vocab_size: int) -> list[Merge]:
    """Merges in rank order from (word, cnt).

    All pairs are counted at the start, and the ``POOL`` most frequent are kept. A round takes from these every merge
    that is certain to come next (the highest count first, then the lowest left id, then the lowest right id), applies
    them to the words in one narrow pass, and brings in the changes of counts. All pairs are counted anew
    only when no pair is left in the pool that is surely ahead of those outside. What reaches the driver is bounded by
    ``POOL``, ``vocab_size`` and the new pairs of a round that are more frequent than the pool's end.
    """
    if not FIRST_MERGE_ID <= vocab_size <= MAX_VOCABULARY:
        raise ValueError(f"vocab_size must be {FIRST_MERGE_ID} to {MAX_VOCABULARY}: {vocab_size}")
    spelling = {i: bytes([b]) for b, i in enumerate(BYTE_IDS)}
    known = {UNKNOWN.encode(): UNKNOWN_ID, **{token: i for i, token in spelling.items()}}
    merges: list[Merge] = []
    symbols = materialise(word_symbols(counts), "bpe-words")
    held: list[DataFrame] = []
    rounds, pool = 0, None
    while len(known) < vocab_size:
        top = pool.top(CANDIDATES) if pool else []
        if not top:
            if pool and pool.end == (0, 0, 0):
                break
            pool = _Pool(_ranked_pairs(symbols).orderBy(F.desc("cnt"), "l", "r").limit(POOL + 1).collect(), POOL)
            top = pool.top(CANDIDATES)
            if not top:
                break
        before = len(known)
        chosen = _sure_prefix(top, vocab_size - len(known), known, spelling)
        for l, r, cnt, token in chosen:
            merges.append(Merge(len(merges), l, r, known[token], cnt))
        symbols = _joined(symbols, [(l, r, known[token]) for l, r, _, token in chosen])
        rounds += 1
        if rounds % ROUNDS_PER_WRITE == 0:
            symbols = materialise(symbols, "bpe-words")
        else:
            held.append(symbols.persist(StorageLevel.MEMORY_AND_DISK))
        if len(known) < before + len(chosen):
            pool = None  # a token came about in a second way, so pairs with it can have gained occurrences
        elif len(known) < vocab_size:
            fresh = [known[token] for *_, token in chosen]
            pool.update(_changes(symbols, fresh, pool.keys(), pool.least()).collect())
            pool.trim(POOL)
            # The job above filled the newest cache, so older ones are no longer needed.
            for frame in held[:-1]:
                frame.unpersist()
            held = held[-1:]
    for frame in held:
        frame.unpersist()
    return merges


def vocabulary(merges: list[Merge]) -> list[tuple[int, str]]:
    """(id, token) with tokens spelled in the printable byte alphabet."""
    tokens = {UNKNOWN_ID: UNKNOWN, **{i: BYTE_SYMBOLS[b] for b, i in enumerate(BYTE_IDS)}}
    for m in merges:
        tokens.setdefault(m.new_id, tokens[m.left] + tokens[m.right])
    return sorted(tokens.items())
