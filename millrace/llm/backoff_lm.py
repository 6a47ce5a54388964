"""Score texts with an n-gram model run as a weighted backoff automaton.

Unigrams are add-one smoothed counts of all words of the training texts. Bigrams and trigrams of all words are kept
from a fixed count on, so their number grows with the corpus, and discounted. Kept n-grams are arcs between states (the longest
kept history); a failure arc leads to the next shorter history at the cost of its backoff weight. A text is
one walk from left to right, and all places of a block walk at once: a state depends on two words only.

Neither the vocabulary nor the n-grams are ever in one place. Documents are dealt into blocks of bounded size and move
once: from then on a block is one packed row of words and places. Each block sends its words and bigrams with their counts
to shards by hash, and gets back the corpus counts of just these. Then it sends those trigrams of which both
bigrams are kept, sharded by history, and gets back their counts and
the sums behind the backoff weights of its own histories.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import mix64, words_of
from millrace.llm.shuffles import free_shuffles
from millrace.session import materialise

END_HASH = np.uint64(0x5851F42D4C957F2D)  # stands for the end token among word hashes
BEGIN_HASH = np.uint64(0x14057B7EF767814F)  # stands for a text's beginning in histories
_PAIR = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class LMParams:
    """``least_count``: n-grams of at least this count are kept. ``word_share`` and ``gram_share`` prune further, and are off: words
    of at least this share of the training tokens may stand in longer n-grams, n-grams of at least this share are
    kept. ``block_chars``: text of a block; ``shard_entries``: counts that a shard holds. Trigrams go out in ``waves``, each of its own
    shards, whose files are dropped before the next."""

    word_share: float = 0.0
    gram_share: float = 0.0
    discount: float = 0.75
    block_chars: int = 4_000_000
    shard_entries: int = 1_500_000
    least_count: int = 2
    waves: int = 2


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the words of each row and its end token; those of row i are first[i] … first[i + 1] - 1."""
    hashes, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, words in words_of(column, lower=True):
        n = np.diff(words.first)
        out = np.full(len(words.hashes) + len(n), END_HASH, np.uint64)
        out[np.arange(len(words.hashes)) + np.repeat(np.arange(len(n)), n)] = words.hashes
        hashes.append(out)
        lengths.append(n + 1)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def _shard_bounds(words: np.ndarray, shards: int) -> np.ndarray:
    """Places in the sorted hashes where each shard's range of hashes begins, and the end."""
    limits = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(words, limits), [len(words)]]).astype(np.int64)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers from 0 on in the fewest bytes that hold them all."""
    return _pack_planes(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


def _pack_planes(values: np.ndarray) -> bytes:
    """Width and number, then all first bytes, all second ones and so on, compressed."""
    width = values.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack_planes(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1)


def unpack_ints(data: bytes) -> np.ndarray:
    return _unpack_planes(data).view(f"u{data[0]}").astype(np.int64)


def pack_floats(values: np.ndarray) -> bytes:
    """Numbers from 0 on; in the fewest bytes where all are quarters, as sums of whole counts less a discount of 0.75 are."""
    quarters = values * 4
    if (quarters == np.floor(quarters)).all() and quarters.max(initial=0) < 1 << 53 and not np.signbit(values).any():
        return b"q" + pack_ints(quarters.astype(np.int64))
    return b"f" + _pack_planes(values)


def unpack_floats(data: bytes) -> np.ndarray:
    return unpack_ints(data[1:]) / 4 if data[:1] == b"q" else _unpack_planes(data[1:]).view(np.float64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte from the lowest: each plane compressed where that is shorter, as the highest are
    nearly all 0. A difference so takes hardly more than the bits that tell it."""
    out = [len(keys).to_bytes(4, "little")]
    for plane in np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T):
        raw = plane.tobytes()
        small = pa.compress(raw, "zstd", asbytes=True) if raw else raw
        out += [min(len(small), len(raw)).to_bytes(4, "little"), small if len(small) < len(raw) else raw]
    return b"".join(out)


def unpack_keys(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:4], "little"), 4
    steps = np.empty((8, n), np.uint8)
    for plane in steps:
        size = int.from_bytes(data[at : at + 4], "little")
        raw = data[at + 4 : at + 4 + size]
        plane[:] = np.frombuffer(raw if size == n else pa.decompress(raw, n, "zstd", asbytes=True), np.uint8)
        at += 4 + size
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "tinyint": pa.int8()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.table([pa.array(list(c), kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)


def _pack_block(table: pa.Table) -> pa.Table:
    """The texts of a block as one row: its distinct words, also by frequency, the word of each place, and the length, mark and id of each text."""
    hashes, first = token_stream(table["text"].combine_chunks())
    words, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # numbers of frequent words are small, so places take fewer bytes
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    train = np.packbits(table["train"].to_numpy()).tobytes()
    row = {"block": table["block"][0].as_py(), "words": pack_keys(words), "common": pack_ints(order), "at": pack_ints(place[at]), "sizes": pack_ints(np.diff(first)), "train": train}
    ids = table["doc_id"].combine_chunks().cast(pa.int64())
    return pa.table([*([x] for x in row.values()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], [*row, "doc_ids"])


class BlockGrams:
    """The distinct words and bigrams of a packed block by hash, and where they stand. ``at`` and ``pair_at`` are the word of each
    place and the bigram that ends there; ``starts`` are the texts' first places, ``taught`` marks those that are learnt from."""

    def __init__(self, row: dict):
        self.first = np.concatenate([[0], np.cumsum(unpack_ints(row["sizes"]))])
        self.starts = self.first[:-1]
        self.taught = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(self.starts)).astype(bool)
        self.train = np.repeat(self.taught, np.diff(self.first))
        self.words, self.at = unpack_keys(row["words"]), unpack_ints(row["common"])[unpack_ints(row["at"])]
        hashes = self.words[self.at]
        before = np.append(BEGIN_HASH, hashes)[:-1]
        before[self.starts] = BEGIN_HASH
        self.pairs, self.pair_at = np.unique(mix64(before * _PAIR + hashes), return_inverse=True)
        self.inner = np.delete(np.arange(len(hashes)), self.starts)  # places with two words, or one and the beginning, before


class KnownCounts:
    """What a block knows after the first replies: corpus counts of its words and bigrams, and which are kept.

    ``histories`` and ``states`` are the histories of one and of two words that may have arcs; trigrams of which both bigrams are kept are
    ``tri``, numbers of (history's bigram, word) in order, and ``tri_at`` those of the places ``tri_places``.
    """

    def __init__(self, grams: BlockGrams, replies: list[dict], least: tuple[int, int], n_train: int):
        self.grams = grams
        replies = sorted(replies, key=lambda r: r["shard"])
        self.count = np.concatenate([unpack_ints(r["counts"]) for r in replies])
        self.pair_count = np.concatenate([unpack_ints(r["pair_counts"]) for r in replies])
        self.owned = np.concatenate([np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=int.from_bytes(r["pair_counts"][1:9], "little")) for r in replies]).astype(bool)
        # A bigram's history and word, from any of its places.
        place = np.empty(len(grams.pairs), np.int64)
        place[grams.pair_at] = np.arange(len(grams.pair_at))
        begins = np.zeros(len(grams.at), bool)
        begins[grams.starts] = True
        self.pair_word = grams.at[place]
        self.pair_history = np.where(begins[place], len(grams.words), grams.at[place - 1])
        self.history_count = np.append(self.count, n_train)  # the beginning comes after the words
        heavy = np.append(self.count >= least[0], True)
        self.kept = (self.pair_count >= least[1]) & heavy[self.pair_history] & heavy[self.pair_word]
        usable = np.flatnonzero(heavy & (self.history_count >= least[1]))
        hashes = np.append(grams.words, BEGIN_HASH)
        self.histories = usable[np.argsort(hashes[usable])]
        self.history_hashes = hashes[self.histories]
        inner = grams.inner
        self.tri_places = inner[self.kept[grams.pair_at[inner - 1]] & self.kept[grams.pair_at[inner]]]
        numbers = grams.pair_at[self.tri_places - 1] * np.int64(len(grams.words)) + grams.at[self.tri_places]
        self.tri, at, self.tri_at = np.unique(numbers, return_index=True, return_inverse=True)
        self.tri_pair = self.tri // max(1, len(grams.words))
        self.tri_lower = self.pair_count[grams.pair_at[self.tri_places[at]]]
        before = np.zeros(len(grams.pairs), bool)
        before[grams.pair_at[inner - 1]] = True
        self.states = np.flatnonzero(before & self.kept)  # two-word histories, as bigrams; also those without a trigram here
        self.tri_state = np.searchsorted(self.states, self.tri_pair)


BLOCK_ROWS = "block bigint, words binary, common binary, at binary, sizes binary, train binary, doc_ids array<bigint>"
COUNT_ROWS = "shard bigint, block bigint, words binary, counts binary, pairs binary, pair_counts binary, tokens bigint, texts bigint"
REPLY_ROWS = "block bigint, shard bigint, counts binary, pair_counts binary, owned binary, known bigint, tokens bigint, texts bigint"
ARC_ROWS = "shard bigint, block bigint, states binary, sizes binary, words binary, word_at binary, counts binary, lower binary, histories binary, sums binary, below binary"
WEIGHT_ROWS = "block bigint, shard bigint, tri_counts binary, state_sums binary, state_below binary, sums binary, below binary"


def _count_block(shards: int):
    """A block's distinct words and bigrams and their training counts, cut by the shard of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            grams = BlockGrams(row)
            counts = np.bincount(grams.at, grams.train, len(grams.words)).astype(np.int64)
            pair_counts = np.bincount(grams.pair_at, grams.train, len(grams.pairs)).astype(np.int64)
            of, pair_of = _shard_bounds(grams.words, shards), _shard_bounds(grams.pairs, shards)
            rows = []
            for s, (a, b, c, d) in enumerate(zip(of[:-1], of[1:], pair_of[:-1], pair_of[1:], strict=True)):
                own = (int(grams.train.sum()), int(grams.taught.sum())) if s == 0 else (0, 0)
                rows.append((s, row["block"], pack_keys(grams.words[a:b]), pack_ints(counts[a:b]), pack_keys(grams.pairs[c:d]), pack_ints(pair_counts[c:d]), *own))
            yield from _table(rows, COUNT_ROWS).to_batches()

    return run


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(totals of the distinct keys, number of each sent key, first place of each distinct key, ends of all but the last sender's keys)."""
    _, place, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return np.bincount(at, np.concatenate(counts), len(place)).astype(np.int64), at, place, np.cumsum([len(k) for k in keys])[:-1]


def _merge_shard(table: pa.Table) -> pa.Table:
    """Corpus counts for each block of a shard, in the order in which the block sent its words and bigrams, with a mark on the
    bigrams that the block answers for; and, as block -1, the number of known words, and the training tokens and texts."""
    column = lambda name, read: [read(x) for x in table[name].to_pylist()]
    totals, at, _, ends = _merged(column("words", unpack_keys), column("counts", unpack_ints))
    pair_totals, pair_at, place, pair_ends = _merged(column("pairs", unpack_keys), column("pair_counts", unpack_ints))
    owned = np.zeros(len(pair_at), bool)
    owned[place] = True
    shard = table["shard"][0].as_py()
    parts = zip(table["block"].to_pylist(), np.split(totals[at], ends), np.split(pair_totals[pair_at], pair_ends), np.split(owned, pair_ends), strict=True)
    rows = [(b, shard, pack_ints(c), pack_ints(p), np.packbits(o).tobytes(), 0, 0, 0) for b, c, p, o in parts]
    rows.append((-1, shard, None, None, None, int((totals > 0).sum()), sum(table["tokens"].to_pylist()), sum(table["texts"].to_pylist())))
    return _table(rows, REPLY_ROWS)


def _send_arcs(shards: range, least: tuple[int, int], n_train: int, discount: float):
    """A block's trigrams with kept bigrams, by the shard of the history, for the shards of one wave; and of its one-word histories
    the discounted counts, and the unigram counts + 1, of the kept bigrams that the block answers for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = BlockGrams(left.to_pylist()[0])
        known = KnownCounts(grams, right.to_pylist(), least, n_train)
        counts = np.bincount(known.tri_at, grams.train[known.tri_places], len(known.tri)).astype(np.int64)
        words = grams.words[known.tri % max(1, len(grams.words))]
        states = grams.pairs[known.states]
        sizes = np.bincount(known.tri_state, minlength=len(states))
        mine = np.flatnonzero(known.kept & known.owned)
        of = known.pair_history[mine]
        sums = np.bincount(of, np.maximum(known.pair_count[mine] - discount, 0), len(grams.words) + 1)[known.histories]
        below = np.bincount(of, known.count[known.pair_word[mine]] + 1, len(grams.words) + 1)[known.histories]
        cut, history_cut = _shard_bounds(states, shards.stop), _shard_bounds(known.history_hashes, shards.stop)
        tri_cut = np.concatenate([[0], np.cumsum(sizes)])[cut]
        block = left["block"][0].as_py()
        rows = []
        for s in shards:
            a, b, c, d, e, f = cut[s], cut[s + 1], tri_cut[s], tri_cut[s + 1], history_cut[s], history_cut[s + 1]
            distinct, at = np.unique(words[c:d], return_inverse=True)
            rows.append((s, block, pack_keys(states[a:b]), pack_ints(sizes[a:b]), pack_keys(distinct), pack_ints(at), pack_ints(counts[c:d]), pack_ints(known.tri_lower[c:d]), pack_keys(known.history_hashes[e:f]), pack_floats(sums[e:f]), pack_floats(below[e:f])))
        return _table(rows, ARC_ROWS)

    return run


def _weigh_shard(least_gram: int, discount: float):
    """For each block of a shard, in the order in which it sent them: corpus counts of its trigrams, and for its histories the discounted
    counts of all kept arcs and those of the same words after the shorter history."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name, read: [read(x) for x in table[name].to_pylist()]
        states = column("states", unpack_keys)
        state_ends = np.cumsum([len(x) for x in states])[:-1]
        distinct, state_at = np.unique(np.concatenate(states), return_inverse=True)
        state = np.repeat(state_at, np.concatenate(column("sizes", unpack_ints)))
        words = [w[at] for w, at in zip(column("words", unpack_keys), column("word_at", unpack_ints), strict=True)]
        tri_ends = np.cumsum([len(x) for x in words])[:-1]
        words = np.concatenate(words)
        order = np.lexsort((words, state))
        opens = np.append(True, (state[order][1:] != state[order][:-1]) | (words[order][1:] != words[order][:-1]))[: len(order)]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(opens) - 1
        first = order[opens]
        totals = np.bincount(at, np.concatenate(column("counts", unpack_ints)), len(first)).astype(np.int64)
        lower = np.concatenate(column("lower", unpack_ints))[first]
        kept = totals >= least_gram
        sums = np.bincount(state[first][kept], np.maximum(totals[kept] - discount, 0), len(distinct))
        below = np.bincount(state[first][kept], np.maximum(lower[kept] - discount, 0), len(distinct))
        histories = column("histories", unpack_keys)
        ends = np.cumsum([len(x) for x in histories])[:-1]
        _, of = np.unique(np.concatenate(histories), return_inverse=True)
        own, under = (np.bincount(of, np.concatenate(column(name, unpack_floats)))[of] for name in ("sums", "below"))
        shard = table["shard"][0].as_py()
        parts = zip(table["block"].to_pylist(), np.split(totals[at], tri_ends), np.split(sums[state_at], state_ends), np.split(below[state_at], state_ends), np.split(own, ends), np.split(under, ends), strict=True)
        return _table([(b, shard, pack_ints(t), *(pack_floats(x) for x in rest)) for b, t, *rest in parts], WEIGHT_ROWS)

    return run


class BackoffAutomaton:
    """The part of the automaton that a block's texts walk through. States are histories of two words, one and none; ``arc`` holds
    the log10 probability of the arc by order and place (NaN where none), ``fall`` the log10 weight of the failure arc of the state
    before each place.

    The discounted mass of a history is what its failure arc hands on, divided by what the shorter history
    gives to words without an arc of their own; so the probabilities after each history add up to 1.
    """

    def __init__(self, known: KnownCounts, replies: list[dict], least_gram: int, discount: float, room: int):
        grams, n = known.grams, len(known.grams.at)
        replies = sorted(replies, key=lambda r: r["shard"])
        total = np.concatenate([unpack_ints(r["tri_counts"]) for r in replies])
        state_sums, state_below, sums, below = (np.concatenate([unpack_floats(r[name]) for r in replies]) for name in ("state_sums", "state_below", "sums", "below"))
        weigh = lambda own, under: np.where(own > 0, np.log10(np.maximum(1 - own, 1e-12) / np.maximum(1 - under, 1e-12)), 0.0)
        one, two = np.zeros(len(grams.words) + 1), np.zeros(len(grams.pairs))
        one[known.histories] = weigh(sums / known.history_count[known.histories], below / room)
        middle = known.history_count[known.pair_word[known.states]]
        two[known.states] = weigh(state_sums / known.pair_count[known.states], state_below / middle)
        self.unigram = np.log10((known.count + 1) / room)[grams.at]
        pair = np.full(len(grams.pairs), np.nan)
        at = np.flatnonzero(known.kept)
        pair[at] = np.log10(np.maximum(known.pair_count[at] - discount, 0) / known.history_count[known.pair_history[at]])
        longest = np.full(len(known.tri), np.nan)
        at = np.flatnonzero(total >= least_gram)
        longest[at] = np.log10(np.maximum(total[at] - discount, 0) / known.pair_count[known.tri_pair[at]])
        self.arc = {2: pair[grams.pair_at], 3: np.full(n, np.nan)}
        self.arc[3][known.tri_places] = longest[known.tri_at]
        self.fall = {1: one[known.pair_history[grams.pair_at]], 2: np.zeros(n)}
        self.fall[2][grams.inner] = two[grams.pair_at[grams.inner - 1]]

    def walk(self) -> np.ndarray:
        """log10 probability of the token at each place: failure arcs until there is an arc, at last the unigram."""
        after_one = np.where(np.isnan(self.arc[2]), self.fall[1] + self.unigram, self.arc[2])
        return np.where(np.isnan(self.arc[3]), self.fall[2] + after_one, self.arc[3])


def score_texts(docs: DataFrame, train: Column, params: LMParams = LMParams()) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from rows where ``train`` is true. Tokens are whitespace-separated words with A-Z
    lower-cased, and one end. base_score adds up log10((c + 1) / (N + V + 1)) with the token's count c among N training
    tokens of V kinds; score is the automaton's log10 probability. Null texts count as empty: one end.
    Without a training row all counts are 0. Repeated rows are scored and counted as often as they occur; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-chars // params.block_chars))
    shards = max(1, -(-(chars // 6) // params.shard_entries))
    # The text tells rows of one id, or without one, apart; equal rows count alike wherever they are.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    packed = materialise(rows.groupBy("block").applyInArrow(_pack_block, BLOCK_ROWS), "lm-blocks")
    free_shuffles(spark)

    sent = packed.drop("doc_ids").mapInArrow(_count_block(shards), COUNT_ROWS)
    merged = materialise(sent.groupBy("shard").applyInArrow(_merge_shard, REPLY_ROWS), "word-counts")
    del sent
    free_shuffles(spark)
    stats = merged.where("block = -1").agg(F.sum("known"), F.sum("tokens"), F.sum("texts")).first()
    vocabulary, tokens, n_train = (x or 0 for x in stats)
    least = (max(1, math.ceil(params.word_share * tokens)), max(params.least_count, math.ceil(params.gram_share * tokens)))
    replies = merged.where("block >= 0").select("block", "shard", "counts", "pair_counts", "owned")

    weights = []
    for wave in range(min(params.waves, shards)):
        paired = packed.drop("doc_ids").groupBy("block").cogroup(replies.groupBy("block"))
        arcs = paired.applyInArrow(_send_arcs(range(wave, shards, params.waves), least, n_train, params.discount), ARC_ROWS)
        weights.append(materialise(arcs.groupBy("shard").applyInArrow(_weigh_shard(least[1], params.discount), WEIGHT_ROWS), "arc-weights"))
        del paired, arcs
        free_shuffles(spark)
    room = tokens + vocabulary + 1

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, ids = BlockGrams(left.drop_columns("doc_ids").to_pylist()[0]), left["doc_ids"].combine_chunks().flatten()
        got = right.to_pylist()
        known = KnownCounts(grams, [r for r in got if r["counts"] is not None], least, n_train)
        automaton = BackoffAutomaton(known, [r for r in got if r["counts"] is None], least[1], params.discount, room)
        add = lambda each: pa.array(np.add.reduceat(each, grams.starts))
        return pa.table(
            [ids, pa.array(np.diff(grams.first)), add((known.count > 0)[grams.at].astype(np.int64)), pa.array(np.full(len(grams.starts), tokens, np.int64)), add(automaton.unigram), add(automaton.walk())],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), weights, replies)
    paired = packed.groupBy("block").cogroup(both.groupBy("block"))
    return paired.applyInArrow(score, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
