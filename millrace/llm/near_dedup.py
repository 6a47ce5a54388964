"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its shingles of five words, each with its count times an inverse document
frequency. Two texts agree in one sample with a probability of their weighted Jaccard similarity.
Samples are banded; texts that share a band are compared with a pivot of that band by their exact
weighted Jaccard similarity, and links make up classes.

Exact copies are one text from the start. A small group of a band is compared in one task. A larger one, however
large, is never paired up: each round compares its members with a few pivots, and members already in a
pivot's class are not compared with it. Pivots leave the group, and rounds go on until what is left of it is small or
lies in one class, so every link between texts that share a band is found or implied by others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.hashing import Words, mix64, prefix_sums, run_hashes, words_of
from millrace.session import materialise


@dataclass(frozen=True)
class NearParams:
    """``frequent``: share of texts from which on a shingle weighs less, falling to ``least_idf`` for one in all
    texts (so that texts of a large group, whose common shingles are frequent, still reach the
    threshold). With 10 bands of 3 samples a link of similarity 0.8 is missed with a chance of 0.0008.
    ``pairs_per_task`` bounds the pairs of a pivot that go to one task; groups of up to ``group_size`` texts
    are compared in one task without pivots. Before, groups above ``fine_from`` are banded anew with ``fine_bands`` of
    ``fine_rows`` samples, which miss a link of similarity 0.8 with a chance of 0.0007."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 10
    rows: int = 3
    frequent: float = 0.02
    least_idf: float = 0.75
    pairs_per_task: int = 500
    group_size: int = 1500
    fine_from: int = 300
    fine_bands: int = 40
    fine_rows: int = 8
    seed: int = 11


def _gamma2_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of 65,536 equal parts, by bisection."""
    want = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        above = 1 - (1 + middle) * np.exp(-middle) > want
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return (low + high) / 2


FROM_LARGE, FROM_SMALL = 4, 16  # pivots of a group's largest class and of its smallest ones
GAMMA = _gamma2_quantiles()
LOG_GAMMA = np.log(GAMMA)


def shingle_bags(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, first): the distinct shingles of row i are first[i] … first[i + 1] - 1, in order.

    A row with fewer than k words has one shingle of all of them; one without words has none.
    """
    n = np.diff(words.first)
    hashes, valid = words.windows(k)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        hashes = hashes.copy()
        hashes[words.first[short]] = run_hashes(prefix_sums(words.hashes), words.first[short], words.first[short + 1])
        valid[words.first[short]] = True
    row = np.repeat(np.arange(len(n)), n)[valid]
    hashes = hashes[valid]
    bounds = np.searchsorted(row, np.arange(len(n) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    places = np.flatnonzero(new)
    counts = np.diff(np.append(places, len(hashes)))
    return hashes[places], counts, np.searchsorted(row[places], np.arange(len(n) + 1))


@dataclass(frozen=True)
class Frequent:
    """The frequent shingles, sorted, and their weights."""

    shingles: np.ndarray
    idf: np.ndarray

    def weights(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(np.float64)
        if len(self.shingles) and len(shingles):
            at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
            hit = self.shingles[at] == shingles
            out[hit] *= self.idf[at[hit]]
        return out


def weighted_samples(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray, n_samples: int, seed: int) -> np.ndarray:
    """(rows with shingles, samples): for each sample the least value over a row's shingles, which names the
    shingle and its level, as r, c and beta come from the shingle's hash and the level from its weight.

    With r and c of gamma(2, 1) and a uniform beta, t = floor(ln w / r + beta), and the value is
    ln a = ln c - r (t - beta + 1).
    """
    some = np.flatnonzero(np.diff(first))
    starts = first[:-1][some]
    out = np.empty((len(some), n_samples))
    other = np.flatnonzero(weights != 1.0)
    logs = np.log(weights[other])
    keys = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, (n_samples, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = mix64(shingles)
    for i, (a, b) in enumerate(keys):
        x = (base ^ a) * b
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        r = GAMMA[(x >> np.uint64(48)).astype(np.intp)]
        beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float64) / 65536
        value = LOG_GAMMA[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)] + r * (beta - 1)
        if len(other):
            value[other] -= r[other] * np.floor(logs / r[other] + beta[other])
        out[:, i] = np.minimum.reduceat(value, starts) if len(starts) else 0
    return out


def _band_keys(samples: np.ndarray, params: NearParams) -> np.ndarray:
    bits = samples.view(np.uint64).reshape(len(samples), params.bands, params.rows)
    key = np.zeros((len(samples), params.bands), np.uint64) + np.arange(1, params.bands + 1, dtype=np.uint64)
    for i in range(params.rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ bits[:, :, i])
    return key.view(np.int64)


def _bags_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, words in words_of(column):
        yield a, b, *shingle_bags(words, k)


def frequent_shingles(docs: DataFrame, params: NearParams) -> Frequent:
    """Shingles in at least the share ``frequent`` of all texts, exactly, without shuffling all shingles.

    A first pass counts texts by hash bucket of the shingle. Buckets below the bound hold no frequent shingle;
    a second pass counts the shingles of the others one by one. There are at most (mean length /
    frequent) such shingles, and a number of buckets in proportion to that, whatever the input's size.
    """
    spark = docs.sparkSession
    n, chars = docs.agg(F.count("text"), F.sum(F.length("text"))).first()
    none = Frequent(np.zeros(0, np.uint64), np.zeros(0))
    if not n or not chars:
        return none
    bound = max(2, math.ceil(params.frequent * n))
    bits = int(np.clip(math.ceil(math.log2(max(1.0, 4 * chars / 5 / bound))), 8, 24))
    k = params.words

    def sketch(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, shingles, _, _ in _bags_of(batch.column(0), k):
                counts += np.bincount((shingles >> np.uint64(64 - bits)).astype(np.intp), minlength=1 << bits)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(counts[filled])], ["bucket", "n"])

    text = docs.select("text")
    buckets = text.mapInArrow(sketch, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= bound)
    full = [r["bucket"] for r in buckets.select("bucket").collect()]
    if not full:
        return none
    wanted = np.zeros(1 << bits, bool)
    wanted[full] = True
    shared = spark.sparkContext.broadcast(wanted)

    def count(batches):
        for batch in batches:
            found = [s[shared.value[(s >> np.uint64(64 - bits)).astype(np.intp)]] for _, _, s, _, _ in _bags_of(batch.column(0), k)]
            values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    exact = text.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= bound)
    rows = sorted((np.uint64(r["shingle"] & (2**64 - 1)), r["n"]) for r in exact.collect())
    shingles = np.array([s for s, _ in rows], np.uint64)
    seen = np.array([c for _, c in rows], np.float64)
    fall = np.log(seen / (params.frequent * n)) / math.log(1 / params.frequent)
    return Frequent(shingles, 1 - (1 - params.least_idf) * np.clip(fall, 0, 1))


def signatures(docs: DataFrame, frequent: Frequent, params: NearParams) -> DataFrame:
    """(doc_id, t1, t2, bands): 128 bits that tell different texts apart, and the band keys (none without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            keys = []
            for a, b, shingles, counts, first in _bags_of(batch.column(3), params.words):
                samples = weighted_samples(shingles, shared.value.weights(shingles, counts), first, params.bands * params.rows, params.seed)
                found = iter(_band_keys(samples, params).tolist())
                keys += [next(found) if n else [] for n in np.diff(first)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")
    return rows.mapInArrow(run, "doc_id bigint, t1 bigint, t2 bigint, bands array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater weights; (shingles, weights), shingles sorted."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = float(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    total = float(a[1].sum() + b[1].sum()) - common
    return common / total if total else 0.0


def verify(pairs: DataFrame, texts: DataFrame, frequent: Frequent, params: NearParams) -> DataFrame:
    """The pairs (a, b) whose texts have at least the threshold's similarity. b may have any number of partners:
    they are dealt over salts, and b's text is repeated once for each."""
    shared = pairs.sparkSession.sparkContext.broadcast(frequent)
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / params.pairs_per_task).cast("int").alias("salts"))
    salts = materialise(salts, "salts")
    left = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).select("a", "b", "salt")
    left = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(salts, "b")
    right = right.select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(batches):
        for batch in batches:
            sides = []
            for column in (2, 3):
                bags = []
                for _, _, shingles, counts, first in _bags_of(batch.column(column), params.words):
                    weights = shared.value.weights(shingles, counts)
                    bags += [(shingles[i:j], weights[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
                sides.append(bags)
            near = [weighted_jaccard(x, y) >= params.threshold for x, y in zip(*sides, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def finer_groups(groups: DataFrame, texts: DataFrame, frequent: Frequent, params: NearParams) -> DataFrame:
    """The groups (band, rep, root), with those above ``fine_from`` members replaced by groups of more selective bands.

    Many texts made from one by edits share bands though most pairs lie below the threshold. Bands of more
    samples, and more of them, part these and still bring a pair at the threshold together.
    """
    sizes = groups.groupBy("band").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > params.fine_from).select("band"), "large-bands")
    if not large.limit(1).count():
        return groups
    ids = groups.join(large, "band", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    fine = replace(params, bands=params.fine_bands, rows=params.fine_rows, seed=params.seed + 1)
    members = signatures(texts.join(ids, "doc_id", "left_semi"), frequent, fine).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    members = materialise(members, "fine-members")
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    found = members.join(shared, "band", "left_semi").select("band", "rep", F.col("rep").alias("root"))
    return groups.join(large, "band", "left_anti").select("band", "rep", "root").unionByName(found)


def choose_pivots(groups: DataFrame) -> DataFrame:
    """(band, size, pivots) of the groups (band, rep, root) with several classes; ``pivots`` is an array of (rep, root).

    Some come from the largest class, to which most others are likely to belong, and some from the smallest, so that
    outliers are soon compared with all. While all classes are of one text, two are enough. They are
    picked by hashing into lanes and taking one from each, which needs no group in one place.
    """
    lane = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    parts = groups.groupBy("band", "root", lane("rep", FROM_LARGE).alias("lane")).agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    classes = parts.groupBy("band", "root").agg(F.sum("n").alias("n"), F.collect_list("rep").alias("reps"))
    lanes = classes.groupBy("band", lane("root", FROM_SMALL).alias("lane")).agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.min(F.struct("n", F.col("reps")[0].alias("rep"), "root")).alias("small"), F.max(F.struct("n", "root", "reps")).alias("large"))
    found = lanes.groupBy("band").agg(F.sum("classes").alias("classes"), F.sum("n").alias("size"), F.collect_list("small").alias("small"), F.max("large").alias("large"))
    pivot = lambda rep, root: F.struct(rep.alias("rep"), root.alias("root"))
    small = F.transform("small", lambda c: pivot(c["rep"], c["root"]))
    large = F.transform("large.reps", lambda r: pivot(r, F.col("large.root")))
    both = F.when(F.col("large.n") == 1, F.slice(small, 1, 2)).otherwise(F.array_distinct(F.concat(small, large)))
    return found.where("classes > 1").select("band", "size", both.alias("pivots"))


def compare_groups(groups: DataFrame, texts: DataFrame, frequent: Frequent, params: NearParams) -> DataFrame:
    """Links (a, b) within groups (band, rep, root) of at most ``group_size`` members, each compared in one task. A
    member is compared with those that are not yet in its class."""
    shared = groups.sparkSession.sparkContext.broadcast(frequent)

    def run(table: pa.Table) -> pa.Table:
        reps, root_of = table["rep"].to_pylist(), table["root"].to_pylist()
        bags = []
        for _, _, shingles, counts, first in _bags_of(table["text"].combine_chunks(), params.words):
            weights = shared.value.weights(shingles, counts)
            bags += [(shingles[i:j], weights[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
        totals = np.array([w.sum() for _, w in bags])
        root_of, links = np.unique(root_of, return_inverse=True)[1], []
        for i, bag in enumerate(bags):
            # The similarity is at most the ratio of the total weights.
            close = np.minimum(totals[:i], totals[i]) >= params.threshold * np.maximum(totals[:i], totals[i]) * (1 - 1e-9)
            for j in np.flatnonzero(close & (root_of[:i] != root_of[i])):
                if root_of[i] != root_of[j] and weighted_jaccard(bag, bags[j]) >= params.threshold:
                    links.append((reps[i], reps[j]))
                    root_of[root_of == root_of[i]] = root_of[j]
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    rows = groups.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("band", "rep", "root", "text")
    return rows.groupBy("band").applyInArrow(run, "a bigint, b bigint")


def near_classes(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs`` (doc_id, text): the smallest doc_id of its class.

    Equal texts share a class, and so do texts linked directly or over others. A null text or one without
    words is its own class; rows of one doc_id are one document; a null doc_id takes no part and has
    a null class. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    frequent = frequent_shingles(docs, params)
    signed = materialise(signatures(docs, frequent, params), "signatures")
    one = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "bands"))).alias("one")
    distinct = signed.where(F.size("bands") > 0).groupBy("t1", "t2").agg(one)
    distinct = materialise(distinct.where("one IS NOT NULL").select("t1", "t2", F.col("one.doc_id").alias("rep"), F.col("one.bands").alias("bands")), "distinct-texts")

    members = distinct.select("rep", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    groups = materialise(members.join(shared, "band").select("band", "rep", F.col("rep").alias("root")), "band-groups")
    firsts = distinct.join(groups.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "t1", "t2")
    texts = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    texts = texts.join(firsts, ["doc_id", "t1", "t2"], "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    texts = materialise(texts.select("doc_id", "text"), "candidate-texts")

    groups = materialise(finer_groups(groups, texts, frequent, params), "finer-groups")

    edges, roots, tested = None, None, None
    while True:
        pivots = materialise(choose_pivots(groups), "pivots")
        if not pivots.limit(1).count():
            break
        groups = materialise(groups.join(pivots, "band"), "open-groups")
        small, groups = groups.where(F.col("size") <= params.group_size), groups.where(F.col("size") > params.group_size)
        found = compare_groups(small.select("band", "rep", "root"), texts, frequent, params)
        is_pivot = F.exists("pivots", lambda p: p["rep"] == F.col("rep"))
        pairs = groups.select("rep", "root", is_pivot.alias("is_pivot"), F.explode("pivots").alias("p")).where("root <> p.root AND (NOT is_pivot OR rep < p.rep)")
        pairs = pairs.select(F.col("rep").alias("a"), F.col("p.rep").alias("b")).distinct()
        if tested is not None:
            flipped = tested.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = pairs.join(tested, ["a", "b"], "left_anti").join(flipped, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if pairs.limit(1).count():
            tested = pairs if tested is None else tested.unionByName(pairs)
            found = found.unionByName(verify(pairs, texts, frequent, params))
        found = materialise(found, "links")
        if found.limit(1).count():
            edges = found if edges is None else edges.unionByName(found)
            roots = components(edges)
        groups = groups.where(~is_pivot).select("band", "rep", "root")
        if roots is not None:
            named = roots.select(F.col("node").alias("rep"), F.col("root").alias("new_root"))
            groups = groups.join(named, "rep", "left").select("band", "rep", F.coalesce("new_root", "root").alias("root"))
        groups = materialise(groups, "band-groups")

    classed = distinct.select("t1", "t2", "rep")
    if roots is not None:
        classed = classed.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("t1", "t2", F.coalesce("root", "rep").alias("class_id"))
    else:
        classed = classed.withColumnRenamed("rep", "class_id")
    rows = signed.select("doc_id", "t1", "t2", (F.size("bands") > 0).alias("worded"))
    joined = rows.join(classed, ["t1", "t2"], "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id"))).alias("class_id"))
