"""Importance resampling towards a target text set, by hashed n-gram features.

A feature's bucket is the CRC-32 of its bytes. What a bucket weighs comes from its exact totals over the corpus and over the
target; a document's weight is the sum over its features, and documents are drawn without replacement by adding
Gumbel noise and taking the highest scores.

CRCs come from a vocabulary with a head and a tail. The most frequent words and pairs of the corpus, counted exactly, are
broadcast: a word with its bucket and with the CRC state after it and a space, from which a longer feature goes on; a pair with its
bucket. Whatever is not among them takes its CRC directly, so the head decides how fast a feature is found and never where
it goes. Tasks sum buckets in arrays of their own before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.llm.ranking import numbered
from millrace.session import materialise

SEGMENT = 1 << 20  # bytes of a text whose words are in memory at once
LONGEST = 64  # bytes of a head word at most, which bounds the broadcast
STEPS = 8  # classes of frequency for each power of two
HELD = 1 << 17  # features that a task counts before it hands the counts on
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class ResampleParams:
    """Features are runs of 1 to ``longest`` words. ``head_words`` and ``head_pairs`` bound the broadcast vocabulary.
    ``percent`` of the documents with at least ``least_words`` words are drawn."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    head_words: int = 1 << 15
    head_pairs: int = 1 << 15


def segments(text: bytes, overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, known) of consecutive pieces of a text: lower-cased words, the first ``known`` of which ended the piece before."""
    clean = text.translate(_CLEAN)
    at, tail = 0, []
    while at < len(clean):
        end = at + SEGMENT
        if end < len(clean):
            space = clean.find(b" ", end)
            end = len(clean) if space < 0 else space
        words = clean[at:end].split()
        yield tail + words, len(tail)
        tail = (tail + words)[-overlap:] if overlap else []
        at = end


def texts_of(column: pa.Array) -> list[bytes | None]:
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


class _Buckets(dict):
    """Buckets of the head's words; any other word takes its CRC."""

    def __init__(self, words, buckets: int):
        super().__init__((w, crc32(w) % buckets) for w in words)
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        return crc32(word) % self.buckets


class _States(dict):
    """CRC states after a head word and a space; any other word's is worked out."""

    def __init__(self, words):
        super().__init__((w, crc32(b" ", crc32(w))) for w in words)

    def __missing__(self, word: bytes) -> int:
        return crc32(b" ", crc32(word))


@dataclass
class Vocabulary:
    """Finds the buckets of all features of a list of words."""

    words: list[bytes]
    pairs: list[tuple[bytes, bytes]]
    params: ResampleParams
    _made: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"words": self.words, "pairs": self.pairs, "params": self.params, "_made": None}

    def tables(self) -> tuple[_Buckets, _States, dict[tuple[bytes, bytes], int]]:
        if self._made is None:
            states = _States(self.words)
            pairs = {(a, b): crc32(b, states[a]) % self.params.buckets for a, b in self.pairs}
            self._made = _Buckets(self.words, self.params.buckets), states, pairs
        return self._made

    def buckets(self, words: list[bytes], known: int = 0) -> list[int]:
        """Buckets of the features that end after the first ``known`` words."""
        single, states, pairs = self.tables()
        found = list(map(single.__getitem__, words[known:]))
        if self.params.longest < 2:
            return found
        n = self.params.buckets
        for i in range(len(words) - 1):
            a, b = words[i], words[i + 1]
            state = states[a]
            if i + 1 >= known:
                bucket = pairs.get((a, b))
                found.append(crc32(b, state) % n if bucket is None else bucket)
            for j in range(i + 2, min(i + self.params.longest, len(words))):
                state = crc32(b" ", crc32(words[j - 1], state))
                if j >= known:
                    found.append(crc32(words[j], state) % n)
        return found


def _most_frequent(docs: DataFrame, size: int, most: int) -> list[tuple[bytes, ...]]:
    """The most frequent runs of ``size`` words, ``most`` of them or fewer, none longer than LONGEST bytes in all; counts are exact.

    Runs are counted by powers of their frequency first, which says from where on there are no more than ``most``. So only these
    reach the driver, not the most frequent ones of each task.
    """

    def count(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["feature", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in texts_of(batch.column(0)):
                for words, _ in segments(text or b"", size - 1):
                    runs = words if size == 1 else [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
                    held.update(r for r in runs if len(r) <= LONGEST)
                    if len(held) > HELD:
                        yield rows()
        yield rows()

    if most < 1:
        return []
    counts = docs.mapInArrow(count, "feature binary, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where("n > 1").withColumn("step", F.floor(F.log2("n") * STEPS)), "run-counts")
    steps, found = None, 0
    for r in counts.groupBy("step").agg(F.count("*").alias("runs")).orderBy(F.desc("step")).collect():  # 64 * STEPS rows at most
        found += r["runs"]
        if found > most:
            break
        steps = r["step"]
    if steps is None:
        return []
    return [tuple(bytes(r["feature"]).split(b" ")) for r in counts.where(F.col("step") >= steps).select("feature").collect()]


def build_vocabulary(docs: DataFrame, params: ResampleParams, column: str = "text") -> Vocabulary:
    text = docs.select(column)
    words = [w for (w,) in _most_frequent(text, 1, params.head_words)]
    pairs = _most_frequent(text, 2, params.head_pairs) if params.longest > 1 else []
    return Vocabulary(words, pairs, params)


def bucket_totals(docs: DataFrame, vocabulary: Vocabulary, column: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    shared, params = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.params

    def total(batches):
        sums = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                for words, known in segments(text or b"", params.longest - 1):
                    sums += np.bincount(shared.value.buckets(words, known), minlength=params.buckets)
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(sums[filled])], ["bucket", "n"])

    return docs.select(column).mapInArrow(total, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, params: ResampleParams) -> np.ndarray:
    """What one feature of each bucket adds to a document's weight, from totals (bucket, n) of corpus and target."""
    b = params.buckets
    seen = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    seen = [tuple(r) for r in seen.groupBy("bucket").agg(F.sum("s"), F.sum("t")).collect()]  # a row for each bucket at most
    of = {k: (s, t) for k, s, t in seen}
    all_s, all_t = (float(sum(x[i] for x in seen)) for i in (1, 2))
    rows = corpus.sparkSession.createDataFrame([(k, *of.get(k, (0, 0))) for k in range(b)], "bucket int, s bigint, t bigint")
    up = (F.col("t") + 1).cast("double") * F.lit(all_s + b)
    down = (F.col("s") + 1).cast("double") * F.lit(all_t + b)
    gain = F.floor(F.lit(1000.0) * F.log(up / down))
    return np.array([r["gain"] for r in rows.select("bucket", gain.alias("gain")).orderBy("bucket").collect()], np.int64)


def weigh(docs: DataFrame, vocabulary: Vocabulary, gains: np.ndarray, keep: list[str], column: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, n_features and weight of each text."""
    schema = docs.select(*keep).schema
    for name in ("n_words", "n_features", "weight"):
        if name in keep:
            raise ValueError(f"a kept column is named {name}")
        schema = schema.add(name, LongType())
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, gains))
    overlap = vocabulary.params.longest - 1

    def run(batches):
        vocabulary, gains = shared.value
        for batch in batches:
            found = []
            for text in texts_of(batch.column(len(keep))):
                n_words = n_features = weight = 0
                for words, known in segments(text or b"", overlap):
                    buckets = vocabulary.buckets(words, known)
                    n_words += len(words) - known
                    n_features += len(buckets)
                    weight += int(gains[buckets].sum()) if buckets else 0
                found.append((n_words, n_features, weight))
            new = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return docs.select(*keep, F.col(column).alias("_text_of_row")).mapInArrow(run, schema)


def noisy(weight: Column, identity: Column, seed: int) -> Column:
    """The weight with Gumbel noise from the hash of seed and id; a null id hashes as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    uniform = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(), id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id_column, n_features, weight, score, rank) for each row of ``docs``; rank is null where it is not drawn.

    ``target`` needs ``column`` only. Null and empty texts have no features and weigh 0. Equal scores go
    to the smaller id, a null id last; rows of one id are documents of their own, told apart by their hash and then
    in no set order. An empty corpus gives no rows, an empty target is one without features. A
    very long text is gone through in pieces of SEGMENT bytes. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(column).alias("text"))
    vocabulary = build_vocabulary(rows, params)
    gains = bucket_gains(bucket_totals(rows, vocabulary), bucket_totals(target.select(F.col(column).alias("text")), vocabulary), params)
    weighed = weigh(rows.withColumn("tie", F.xxhash64("text")), vocabulary, gains, ["id", "tie"])
    scored = weighed.withColumn("score", noisy(F.col("weight"), F.col("id"), params.seed)).withColumn("able", F.col("n_words") >= params.least_words)
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    drawn = scored.where("able").count() * params.percent // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie").asc(), F.col("row").asc()]
    ranked = numbered(scored, order, "rank")
    rank = F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select(F.col("id").alias(id_column), "n_features", "weight", "score", rank.cast("bigint").alias("rank"))
