"""Exact Jaccard join of word n-gram sets by T-occurrence search with DivideSkip.

A document is the set of its distinct shingles; two are linked when their sets' Jaccard similarity reaches the threshold. A
set of n shingles can only be linked with one that shares T = ceil(threshold * n) of them or more. So:

1. Equal sets are one node from the start.
2. Of each node, the shingles that come first in one fixed order are counted over all nodes. Where too few of them
   stand in another node as well for T to be reached, the node is closed. This leaves the few nodes that may have partners.
3. Of the others all shingles are counted, and each is put in order of its frequency. Linked nodes share one of their
   n - T + 1 rarest, so nodes that share one are put in one cluster, by edges from each shingle's smallest node.
4. Clusters go to tasks, small ones together and large ones in blocks, each block with each. A task builds the inverted
   lists of one block and searches every node of the other (DivideSkip): the longest lists are set aside, the short ones
   are merged and give those that stand in enough of them, and these are looked up in the long lists by binary search.

Steps 2 and 3 drop nodes that provably have no link; no list, candidate or partner is cut off. A task returns counts of links
and a spanning forest of them, never pairs of a whole group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.hashing import Words, mix64, prefix_sums, run_hashes, words_of
from millrace.llm.shuffles import free_shuffles
from millrace.session import materialise


@dataclass(frozen=True)
class JoinParams:
    """Sets are linked from ``percent`` per cent similarity on. ``block_shingles`` bounds the shingles of the two
    blocks that a task compares (but for a single larger set). ``skip`` is DivideSkip's constant mu: the larger, the fewer
    lists are set aside. ``first_share``: how many per cent more shingles than needed for one hit step 2 counts."""

    words: int = 5
    percent: int = 80
    block_shingles: int = 1 << 20
    skip: float = 0.01
    first_share: int = 10


def distinct_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, first): the distinct shingles of row i, in order, are first[i] … first[i + 1] - 1."""
    n = np.diff(words.first)
    hashes, valid = words.windows(k)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence is the one shingle
        hashes[words.first[short]] = run_hashes(prefix_sums(words.hashes), words.first[short], words.first[short + 1])
        valid[words.first[short]] = True
    row = np.repeat(np.arange(len(n)), n)[valid]
    order = np.lexsort((hashes[valid], row))
    row, hashes = row[order], hashes[valid][order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def least_overlap(n, percent: int):
    """T: what a set of n shares with a linked one at least."""
    return -(-n * percent // 100)


def extra(n, share: int):
    """How many hits among the first n - T + extra shingles a set of n is asked for."""
    return np.maximum(1, -(-n * share // 100))


def set_keys(docs: DataFrame, params: JoinParams) -> DataFrame:
    """(id, t1, t2, n, k1, k2, firsts) of rows (id, t1, t2, text): 128 bits that name the set, and the shingles that step 2 counts."""

    def run(batches):
        for batch in batches:
            ns, keys, firsts = [], [], []
            for _, _, words in words_of(batch.column(3), lower=True):
                shingles, first = distinct_shingles(words, params.words)
                n = np.diff(first)
                sums = [np.append(np.zeros(1, np.uint64), np.cumsum(mix64(shingles ^ np.uint64(salt)))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                ns.append(n)
                keys.append(np.stack([mix64((s[first[1:]] - s[first[:-1]]) ^ n.astype(np.uint64)) for s in sums]))
                taken = np.where(n > 0, n - least_overlap(n, params.percent) + np.minimum(extra(n, params.first_share), least_overlap(n, params.percent)), 0)
                at = np.repeat(first[:-1] - np.append(0, np.cumsum(taken)[:-1]), taken) + np.arange(taken.sum())
                firsts.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken)).astype(np.int32)), pa.array(shingles[at].view(np.int64))))
            if not ns:
                continue
            k1, k2 = np.concatenate(keys, axis=1).view(np.int64)
            found = pa.chunked_array(firsts, pa.list_(pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(ns).astype(np.int64)), pa.array(k1), pa.array(k2), found], ["id", "t1", "t2", "n", "k1", "k2", "firsts"])

    return docs.select("id", "t1", "t2", "text").mapInArrow(run, "id bigint, t1 bigint, t2 bigint, n bigint, k1 bigint, k2 bigint, firsts array<bigint>")


def whole_sets(texts: DataFrame, params: JoinParams) -> DataFrame:
    """(node, shingles) of rows (node, text), shingles in order."""

    def run(batches):
        for batch in batches:
            at = 0
            for _, _, words in words_of(batch.column(1), lower=True):
                shingles, first = distinct_shingles(words, params.words)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lists)), lists], ["node", "shingles"])
                at += len(lists)

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _column_overlap(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100)).cast("bigint")


def _seen_twice(rows: DataFrame) -> DataFrame:
    """Rows (node, shingle, …) whose shingle stands in several nodes, with ``df``: in how many.

    Counts are summed in each task first; the join back splits a frequent shingle's rows.
    """
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    return rows.join(counts, "shingle")


def open_nodes(nodes: DataFrame, params: JoinParams) -> DataFrame:
    """The nodes (node, n, firsts) that have enough of their first shingles in common with others.

    A partner has T shingles or more, so it counts extra(T) more than one hit needs, or more; the first extra(T)
    shingles in common are among the first of both.
    """
    shared = _seen_twice(nodes.select("node", F.explode("firsts").alias("shingle")))
    hits = nodes.select("node", "n").join(shared.groupBy("node").agg(F.count("*").alias("hits")), "node")
    least = F.greatest(F.lit(1), F.ceil(_column_overlap(F.col("n"), params.percent) * params.first_share / F.lit(100)))
    return hits.where(F.col("hits") >= least).select("node", "n")


def clusters(sets: DataFrame, params: JoinParams) -> DataFrame:
    """(node, cluster) of the nodes (node, n, shingles) that share one of their n - T + 1 rarest shingles with another.

    Shingles are in order of the number of nodes they stand in, then of their value. Those of one node only
    come first and link nothing, so they are counted and not moved.
    """
    shared = _seen_twice(sets.select("node", "n", F.explode("shingles").alias("shingle")))
    by_node = Window.partitionBy("node")
    own = F.col("n") - F.count("*").over(by_node)
    place = F.row_number().over(by_node.orderBy("df", "shingle"))
    rare = shared.select("node", "shingle", "n", own.alias("own"), place.alias("place")).where(F.col("own") + F.col("place") <= F.col("n") - _column_overlap(F.col("n"), params.percent) + 1)
    rare = materialise(rare.select("node", "shingle"), "rare-shingles")
    least = rare.groupBy("shingle").agg(F.min("node").alias("b"))
    edges = rare.join(least, "shingle").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    return components(edges).select("node", F.col("root").alias("cluster"))


class Lists:
    """The inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(every, kind="stable")  # owners stay in order within a list
        every, self.owners = every[order], owner[order]
        self.sizes = sizes
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        self.shingles = every[new]
        self.first = np.append(np.flatnonzero(new), len(every))
        # Of a list's number and an owner; in order, so that a binary search in it is one in the list.
        self.keys = np.repeat(np.arange(len(self.shingles)), np.diff(self.first)) * len(sets) + self.owners

    def search(self, query: np.ndarray, percent: int, skip: float) -> np.ndarray:
        """The sets of the block that are linked with ``query``."""
        n = len(query)
        at = np.searchsorted(self.shingles, query)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == query] if len(self.shingles) else at[:0]
        needed = int(least_overlap(n, percent))
        if len(at) < needed:
            return np.zeros(0, np.intp)
        length = self.first[at + 1] - self.first[at]
        at = at[np.argsort(length, kind="stable")]
        # DivideSkip: so many lists are set aside, the longest.
        aside = min(needed - 1, int(needed / (skip * math.log2(max(2, int(length.max()))) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        # A list is a sorted run; a stable sort merges runs.
        merged = np.concatenate([self.owners[a:b] for a, b in zip(self.first[short].tolist(), self.first[short + 1].tolist(), strict=True)])
        merged.sort(kind="stable")
        starts = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        found, hits = merged[starts].astype(np.int64), np.diff(np.append(starts, len(merged)))
        size = self.sizes[found]
        able = (hits >= needed - aside) & (size * 100 >= n * percent) & (n * 100 >= size * percent)
        found, hits, size = found[able], hits[able], size[able]
        for some in np.array_split(np.arange(len(found)), max(1, len(found) * len(long) >> 22)):
            probes = long[:, None] * len(self.sizes) + found[some][None, :]
            places = np.searchsorted(self.keys, probes)
            places[places == len(self.keys)] = 0
            hits[some] += (self.keys[places] == probes).sum(axis=0)
        return found[hits * 100 >= percent * (n + size - hits)]


def join_blocks(left: list[np.ndarray], right: list[np.ndarray] | None, params: JoinParams):
    """Links as arrays (i, j) of places in left and right; within left, i > j, where right is None."""
    lists = Lists(left if right is None else right)
    for i, query in enumerate(left):
        found = lists.search(query, params.percent, params.skip)
        yield i, found[found < i] if right is None else found


def linked(members: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b, n): links of nodes (node, cluster, mult, shingles), as rows of two kinds. With b, a link of a spanning forest; without,
    ``n`` documents are linked with the node a. Clusters above the limit are cut into blocks and each block meets each."""
    sized = members.groupBy("cluster").agg(F.sum(F.size("shingles")).alias("total"))
    sized = materialise(sized, "cluster-sizes")
    half = params.block_shingles // 2
    bins = max(1, math.ceil((sized.where(F.col("total") <= half).agg(F.sum("total")).first()[0] or 0) / params.block_shingles))
    rows = members.join(sized.withColumn("blocks", F.ceil(F.col("total") / half)), "cluster")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    small = F.col("blocks") == 1
    # A row for each block that this block meets: (i, j), i <= j.
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = rows.select("node", "mult", "shingles", own.alias("own"), F.when(small, F.lit(-1)).otherwise(F.col("cluster")).alias("group"),
                       F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("bin"), F.explode(meets).alias("at"))
    rows = rows.select("group", F.coalesce("bin", F.col("at.i")).alias("i"), F.coalesce("bin", F.col("at.j")).alias("j"), "own", "node", "mult", "shingles")

    def run(table: pa.Table) -> pa.Table:
        nodes, mult = table["node"].to_numpy(), table["mult"].to_numpy()
        lists = table["shingles"].combine_chunks()
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        sets = [flat[a:b].view(np.uint64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        one = table["group"][0].as_py() == -1 or table["i"][0].as_py() == table["j"][0].as_py()
        side = np.zeros(len(nodes), bool) if one else table["own"].to_numpy() == table["j"][0].as_py()
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        if not one and not (len(left) and len(right)):
            right = left[:0]
        count, root, forest = np.zeros(len(nodes), np.int64), list(range(len(nodes))), []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        pairs = join_blocks([sets[x] for x in left], None if one else [sets[x] for x in right], params) if one or len(right) else ()
        for i, found in pairs:
            x, others = int(left[i]), (left if one else right)[found]
            count[x] += mult[others].sum()
            count[others] += mult[x]
            for y in others.tolist():
                p, q = find(x), find(y)
                if p != q:
                    root[p] = q
                    forest.append((x, y))
        known = np.flatnonzero(count)
        a = np.concatenate([nodes[[x for x, _ in forest]], nodes[known]]) if forest else nodes[known]
        b = pa.concat_arrays([pa.array(nodes[[y for _, y in forest]] if forest else nodes[:0], pa.int64()), pa.nulls(len(known), pa.int64())])
        n = pa.concat_arrays([pa.nulls(len(forest), pa.int64()), pa.array(count[known], pa.int64())])
        return pa.table([pa.array(a, pa.int64()), b, n], ["a", "b", "n"])

    return rows.groupBy("group", "i", "j").applyInArrow(run, "a bigint, b bigint, n bigint")


def jaccard_join(docs: DataFrame, params: JoinParams = JoinParams(), id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id_column, n_shingles, component_id, n_links) for each row: the size of its set, the smallest id that links
    lead to, its own included, and how many other rows it is linked with directly.

    A text without words has no set and is linked with nothing. Rows with equal sets are linked; rows of one id are
    documents of their own. A row without an id takes no part: its component_id and n_links are null. An
    empty table gives no rows. A text may be of any length; its shingles are unfolded in one task. Other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    signed = materialise(set_keys(rows, params), "set-keys")
    able = signed.where("id IS NOT NULL AND n > 0")
    named = able.groupBy("k1", "k2").agg(F.count("*").alias("mult"), F.min(F.struct("id", "t1", "t2")).alias("one"), F.first("n").alias("n"), F.min("id").alias("least"))
    nodes = materialise(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
    firsts = able.join(nodes.select("node", "one.*"), ["id", "t1", "t2"]).select("node", "n", "firsts").dropDuplicates(["node"])
    firsts = materialise(firsts, "first-shingles")
    still = materialise(open_nodes(firsts, params), "open-nodes")
    free_shuffles(docs.sparkSession)

    wanted = nodes.join(still.select("node"), "node", "left_semi").select("node", "one.*")
    texts = rows.join(wanted, ["id", "t1", "t2"]).select("node", "text").dropDuplicates(["node"])
    sets = materialise(whole_sets(texts, params).withColumn("n", F.size("shingles").cast("bigint")), "open-sets")
    free_shuffles(docs.sparkSession)
    placed = materialise(clusters(sets, params), "clusters")
    free_shuffles(docs.sparkSession)
    members = sets.join(placed, "node").join(nodes.select("node", "mult"), "node")
    found = materialise(linked(members, params), "links")

    roots = components(found.where("b IS NOT NULL").select("a", "b")).select("node", "root")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    grown = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component"))
    classed = nodes.join(roots.join(grown, "root").select("node", "component"), "node", "left").join(counts, "node", "left")
    classed = classed.select("k1", "k2", F.coalesce("component", "least").alias("component"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    known = signed.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("k1")).alias("k1"), "k2")
    joined = known.where("k1 IS NOT NULL").join(classed, ["k1", "k2"]).select("id", "n", "component", "links")
    rest = known.where("k1 IS NULL").select("id", "n", F.col("id").alias("component"), F.when(F.col("id").isNotNull(), F.lit(0).cast("bigint")).alias("links"))
    both = joined.unionByName(rest)
    return both.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))
