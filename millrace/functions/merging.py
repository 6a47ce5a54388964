"""Numpy helpers that work on many words at once: flat symbol ids plus a word number for each."""

from __future__ import annotations

import numpy as np

NO_RANK = np.iinfo(np.int64).max


def pair_keys(ids: np.ndarray) -> np.ndarray:
    """Each symbol with its successor as one integer."""
    return ids[:-1].astype(np.int64) << 32 | ids[1:]


def same_word(word: np.ndarray) -> np.ndarray:
    return word[:-1] == word[1:]


def without_overlap(hits: np.ndarray) -> np.ndarray:
    """Of pair positions that follow one another directly, keep every second one from the left."""
    if len(hits) < 2:
        return hits
    fresh = np.concatenate([[True], np.diff(hits) != 1])
    first = np.maximum.accumulate(np.where(fresh, hits, 0))
    return hits[(hits - first) % 2 == 0]


def join_at(ids: np.ndarray, word: np.ndarray, hits: np.ndarray, new_ids) -> tuple[np.ndarray, np.ndarray]:
    """Replace the pairs that start at ``hits`` by ``new_ids``."""
    ids = ids.copy()
    ids[hits] = new_ids
    keep = np.ones(len(ids), bool)
    keep[hits + 1] = False
    return ids[keep], word[keep]


class RankTable:
    """Merge ranks by symbol pair, as sorted arrays."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        keys = np.array([l << 32 | r for l, r, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.new_ids = np.array([n for _, _, n in merges], np.int32)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), NO_RANK)
        at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)


def merge_words(ids: np.ndarray, word: np.ndarray, table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """Per word, join the lowest-ranked pair everywhere until no pair has a rank.

    ``word`` is non-decreasing. Words leave the loop once they are finished.
    """
    done_ids, done_word = [], []
    while len(ids):
        rank = np.full(len(ids), NO_RANK)
        inside = np.flatnonzero(same_word(word))
        rank[inside] = table.rank_of(pair_keys(ids)[inside])
        first = np.flatnonzero(np.concatenate([[True], ~same_word(word)]))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
        open_ = best != NO_RANK
        done_ids.append(ids[~open_])
        done_word.append(word[~open_])
        ids, word, rank, best = ids[open_], word[open_], rank[open_], best[open_]
        hits = without_overlap(np.flatnonzero(rank == best))
        ids, word = join_at(ids, word, hits, table.new_ids[rank[hits]])
    if not done_ids:
        return ids, word
    order = np.argsort(np.concatenate(done_word), kind="stable")
    return np.concatenate(done_ids)[order], np.concatenate(done_word)[order]


def take_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs, one after the other."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return np.arange(ends[-1] if len(ends) else 0) + shift
