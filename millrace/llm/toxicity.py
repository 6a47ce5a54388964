"""Toxicity of documents and sentences by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. Each sentence has a logistic score of
its words; a document's is their noisy-or, 1 - prod(1 - p). The words' weights are trained
through the noisy-or from document labels, so the sentence scores tell which ones offend.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
STEM, LONGEST_STEM = 4, 9  # characters
CACHE = 300_000  # words whose weights a worker keeps


@dataclass(frozen=True)
class ToxicityParams:
    """``docs_per_class`` bounds the training sample, in expectation, chosen by hash of the id. Words of
    fewer than ``min_docs`` documents of the sample, or spread over the classes as by chance, have no weight."""

    docs_per_class: int = 2500
    min_docs: int = 4
    least_chi2: float = 15.0
    steps: int = 200
    rate: float = 0.1
    decay: float = 1e-4
    least_weight: float = 0.05


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def features(word: str) -> list[str]:
    """A word and its beginnings, by which unseen inflections and compounds are known."""
    return [word, *[word[:k] + "*" for k in range(STEM, min(len(word), LONGEST_STEM) + 1)]]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences: runs between full stops, exclamation and question marks and line ends."""
    return [m.span() for m in SENTENCE.finditer(text)]


def telling(inside: int, outside: int, toxic: int, clean: int, params: ToxicityParams) -> bool:
    """Does a word occur in toxic and in clean documents unevenly beyond chance (chi-squared)?"""
    n, seen = toxic + clean, inside + outside
    if seen < params.min_docs or seen == n:
        return False
    cross = float(inside * (clean - outside) - outside * (toxic - inside))
    return n * cross**2 / (float(toxic) * clean * seen * (n - seen)) >= params.least_chi2


def fit_noisy_or(texts: list[str], labels: np.ndarray, importance: np.ndarray, params: ToxicityParams) -> ToxicityModel:
    """Minimise the weighted log loss of the noisy-or over documents by Adam.

    With H the sum of softplus(z) over sentences, 1 - prod(1 - p) = 1 - exp(-H). The loss is H for a clean
    document and -log(1 - exp(-H)) for a toxic one.
    """
    bags = [[{f for w in set(TOKEN.findall(t[a:b].lower())) for f in features(w)} for a, b in sentences(t)] for t in texts]
    toxic = labels.astype(bool)
    inside, outside = Counter(), Counter()
    for bag, bad in zip(bags, toxic, strict=True):
        (inside if bad else outside).update(set().union(*bag))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w in inside | outside if telling(inside[w], outside[w], toxic.sum(), (~toxic).sum(), params)))}
    word, sentence, doc, n = [], [], [], 0
    for d, bag in enumerate(bags):
        for words in bag:
            known = [vocabulary[w] for w in words if w in vocabulary]
            word += known
            sentence += [n] * len(known)
            doc.append(d)
            n += 1
    word, sentence, doc = np.array(word, np.int64), np.array(sentence, np.int64), np.array(doc, np.int64)
    value = np.zeros(len(vocabulary) + 1)
    value[-1] = -6.0
    first, second = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, params.steps + 1):
        z = np.bincount(sentence, value[word], n) + value[-1]
        total = np.maximum(np.bincount(doc, softplus(z), len(texts)), 1e-12)
        slope = np.where(toxic, -np.exp(-total) / -np.expm1(-total), 1.0) * importance
        by_sentence = slope[doc] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(word, by_sentence[sentence], len(vocabulary)), by_sentence.sum())
        gradient[:-1] += params.decay * value[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        value -= params.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    kept = {w: float(value[i]) for w, i in vocabulary.items() if abs(value[i]) >= params.least_weight}
    return ToxicityModel(kept, float(value[-1]))


def weigh(sentence: str, weights: dict[str, float], known: dict[str, bool]) -> list[float]:
    """The weights of a sentence's distinct features that have any, in a fixed order; ``known`` remembers which words have any."""
    words = []
    for word in set(TOKEN.findall(sentence.lower())):
        any_weight = known.get(word)
        if any_weight is None:
            any_weight = known[word] = any(f in weights for f in features(word))
        if any_weight:
            words.append(word)
    return [weights[f] for f in sorted({f for w in words for f in features(w)}) if f in weights] if words else []


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on the texts of ``docs`` (doc_id, text) with a row in ``labels`` (doc_id, toxic).

    Null labels and ids are left out, an id with several labels counts as toxic if one is. Null texts
    count as empty. Without labelled rows of both classes the model scores every text 0.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = materialise(marked, "toxicity-labels")
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return ToxicityModel({}, -np.inf)
    chance = F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))
    share = {k: min(1.0, params.docs_per_class / n) for k, n in counts.items()}
    chosen = marked.where(chance < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # At most 2 * docs_per_class ids in expectation, so they can go to every task.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    total = sum(counts.values())

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        toxic = table["toxic"].to_numpy()
        drawn = {k: max(1, int((toxic == k).sum())) for k in counts}
        importance = np.where(toxic == 1, counts[1] / drawn[1], counts[0] / drawn[0]) / total
        model = fit_noisy_or(table["text"].to_pylist(), toxic, importance, params)
        return pa.table({"word": [*model.weights, None], "weight": [*model.weights.values(), model.bias]}, pa.schema([("word", pa.string()), ("weight", pa.float64())]))

    fitted = sample.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: fit(t), "word string, weight double")
    rows = materialise(fitted, "toxicity-model").collect()
    bias = [r["weight"] for r in rows if r["word"] is None]
    return ToxicityModel({r["word"]: r["weight"] for r in rows if r["word"] is not None}, bias[0] if bias else -np.inf)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, score, predicted and ``offending``, for every whole text.

    ``score`` is the noisy-or of the sentences (0 without a sentence, as for null and empty texts),
    ``predicted`` is 1 from 0.5 on. ``offending`` lists (start, end, score) in characters of the sentences
    that score 0.5 or more. Equal texts score the same; columns not in ``keep`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.simpleString()[7:-1]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        weights, bias = shared.value.weights, shared.value.bias
        rest = float(softplus(np.array(bias)))
        known: dict[str, bool] = {}
        for batch in batches:
            scores, found = [], []
            if len(known) > CACHE:
                known.clear()
            for text in batch.column(len(keep)).to_pylist():
                hazard, spans = 0.0, []
                for a, b in sentences(text or ""):
                    some = weigh(text[a:b], weights, known)
                    if not some:
                        hazard += rest
                        continue
                    z = bias + sum(some)
                    hazard += float(softplus(np.array(z))) if z < 30 else z
                    if z >= 0:
                        spans.append({"start": a, "end": b, "score": 1 / (1 + float(np.exp(-z)))})
                scores.append(-float(np.expm1(-hazard)))
                found.append(spans)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, span)],
                [*keep, "score", "predicted", "offending"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{schema}, score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>")
