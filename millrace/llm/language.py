"""Language identification by unigram models of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece, fitted
by expectation maximisation over all segmentations of the words of a bounded sample. A
word's probability is the forward sum over its segmentations, a text's the product over its words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import row_slices
from millrace.session import materialise

UNKNOWN = -18.0  # log-probability of a character that no piece covers, in every language
SMOOTH = 0.01  # expected count added to every piece
CACHE = 700_000  # words whose sums a worker keeps from batch to batch
AT_ONCE = 20_000  # words summed together
LONG = 30  # characters of a word whose probability stays above the least float


@dataclass(frozen=True)
class LanguageParams:
    """``docs_per_language`` bounds the sample a language's model is fitted on (in expectation, chosen by
    hash); ``max_languages`` bounds the models, which are broadcast. ``vocabulary`` is a sentencepiece file."""

    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    docs_per_language: int = 400
    rounds: int = 3
    max_languages: int = 400


def load_pieces(path: str) -> list[str]:
    """The pieces that stand for text, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in pieces if "▁" not in p[1:]]  # a word has its mark at the beginning only


class PieceLattice:
    """All places of all pieces in a word, by an automaton over the vocabulary."""

    def __init__(self, pieces: list[str]):
        import ahocorasick

        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, piece in enumerate(pieces):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()

    def arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) by end; piece -1 is a single character that is no piece itself."""
        found = [(end + 1 - int(self.sizes[number]), end + 1, number) for end, number in self.automaton.iter(word)]
        single = {start for start, end, _ in found if end - start == 1}
        found += [(i, i + 1, -1) for i in range(len(word)) if i not in single]
        found.sort(key=lambda arc: arc[1])
        return found


def forward(arcs, length: int, logs: np.ndarray) -> np.ndarray:
    """log of the sum over segmentations, for every language; ``logs`` is (pieces + 1, languages), its last row UNKNOWN."""
    best = np.full((length + 1, logs.shape[1]), -np.inf)
    best[0] = 0
    for start, end, piece in arcs:
        best[end] = np.logaddexp(best[end], best[start] + logs[piece])
    return best[length]


def word_scores(lattice: PieceLattice, words: list[str], logs: np.ndarray) -> np.ndarray:
    """``forward`` of many words at once: (words, languages).

    The automaton reads all words in one string; pieces that would reach from one word into the next are
    left out. Sums then grow by end place, for all words and languages together, in plain
    probabilities where a word is too short for them to underflow.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1  # each word has one place more than it has characters
    found = np.fromiter(chain.from_iterable(lattice.automaton.iter("".join(words))), np.int64)
    char_first = np.cumsum(lengths) - lengths
    end, piece = found[::2] + 1, found[1::2]
    size = lattice.sizes[piece]
    word_of = np.repeat(np.arange(len(words)), lengths)
    word = word_of[end - 1]
    inside = end - size >= char_first[word]
    end, size, piece, word = end[inside], size[inside], piece[inside], word[inside]
    single = np.zeros(int(lengths.sum()), bool)
    single[end[size == 1] - 1] = True
    rest = np.flatnonzero(~single)
    end, size, piece = np.append(end, rest + 1), np.append(size, 1 + 0 * rest), np.append(piece, np.full(len(rest), len(logs) - 1))
    word = np.append(word, word_of[rest])
    level = end - char_first[word]
    order = np.argsort(level * len(words) + word, kind="stable")
    order = order[lengths[word[order]] <= LONG]
    level, size, piece, word = level[order], size[order], piece[order], word[order]
    probs = np.exp(logs)
    sums = np.zeros((int(lengths.sum()) + len(words), logs.shape[1]))
    sums[first] = 1.0
    bounds = np.searchsorted(level, np.arange(1, LONG + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a < b:
            to = word[a:b]
            begins = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            place = first[to] + level[a:b]
            sums[place[begins]] = np.add.reduceat(sums[place - size[a:b]] * probs[piece[a:b]], begins)
    with np.errstate(divide="ignore"):
        out = np.log(sums[first + lengths])
    for i in np.flatnonzero(lengths > LONG):
        out[i] = forward(lattice.arcs(words[i]), len(words[i]), logs)
    return out


def text_words(text: str) -> list[str]:
    return ["▁" + w for w in text.split()]


def add_long(expected: list[float], arcs: list[tuple[int, int, int]], n: int, count: int, logs: list[float]) -> None:
    """Add the expected pieces of a word of any length, in log space, where plain sums would underflow."""

    def sums(at, order, of, to):
        place = -1
        for arc in [*order, (None, None, None)]:
            if arc[to] != place:
                if place != -1:
                    top = max(terms)
                    at[place] = top + math.log(math.fsum(math.exp(t - top) for t in terms))
                place, terms = arc[to], []
            if arc[0] is not None:
                terms.append(at[arc[of]] + logs[arc[2]])

    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)  # every place is reached, as single characters are arcs
    sums(ahead, arcs, 0, 1)
    sums(behind, sorted(arcs, key=lambda a: -a[0]), 1, 0)
    for s, e, k in arcs:
        expected[k] += count * math.exp(ahead[s] + logs[k] + behind[e] - ahead[n])


def fit_unigrams(lattice: PieceLattice, n_pieces: int, words: dict[str, int], rounds: int) -> np.ndarray:
    """log-probabilities of the pieces by expectation maximisation over all segmentations of ``words``."""
    probs = np.full(n_pieces + 1, 1.0 / n_pieces)
    probs[-1] = math.exp(UNKNOWN)
    for _ in range(rounds):
        p, logs = probs.tolist(), np.log(probs).tolist()
        expected = [SMOOTH] * (n_pieces + 1)
        for word, count in words.items():  # lattices are made anew, as those of all words would fill the memory
            n = len(word)
            arcs = lattice.arcs(word)
            if n > LONG:  # a sentence or more, in scripts without spaces
                add_long(expected, arcs, n, count, logs)
                continue
            ahead = [0.0] * (n + 1)
            ahead[0] = 1.0
            for s, e, k in arcs:
                ahead[e] += ahead[s] * p[k]
            behind = [0.0] * (n + 1)
            behind[n] = 1.0
            for s, e, k in sorted(arcs, key=lambda a: -a[0]):
                behind[s] += behind[e] * p[k]
            if ahead[n] <= 0:
                continue
            scale = count / ahead[n]
            for s, e, k in arcs:
                expected[k] += scale * ahead[s] * p[k] * behind[e]
        probs = np.array(expected)
        probs[:-1] /= probs[:-1].sum()
        probs[-1] = math.exp(UNKNOWN)
    return np.log(probs)


@dataclass(frozen=True)
class LanguageModel:
    """``logs`` is (pieces + 1, languages)."""

    languages: tuple[str, ...]
    priors: tuple[float, ...]
    logs: np.ndarray
    params: LanguageParams


def fit_languages(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on rows (doc_id, text, lang) with a text and a lang; other columns are ignored.

    The number of rows of each language is counted over all rows, then a hash of the id picks the
    sample. Without a labelled row the model has no language, and every text is ``und``.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy("lang").limit(params.max_languages + 1).collect()
    if len(counts) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages; see LanguageParams.max_languages")
    if not counts:
        return LanguageModel((), (), np.zeros((1, 0)), params)
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(params.docs_per_language / r["count"]))])
    chance = (F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit(2**53 - 1))) / F.lit(float(2**53))
    shared = spark.sparkContext.broadcast(load_pieces(params.vocabulary))  # a fixed file of some hundred kB
    sample = known.select("lang", "text").where(chance < rate[F.col("lang")])
    rounds = params.rounds

    def count(batches):
        for batch in batches:
            found = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(text_words(text))
            for lang, words in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    def fit(table: pa.Table) -> pa.Table:
        pieces = shared.value
        words = dict(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))
        logs = fit_unigrams(PieceLattice(pieces), len(pieces), words, rounds)
        return pa.table({"lang": [table["lang"][0].as_py()], "logs": pa.array([logs.tolist()], pa.list_(pa.float64()))})

    words = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = words.groupBy("lang").applyInArrow(fit, "lang string, logs array<double>")
    found = {r["lang"]: r["logs"] for r in materialise(fitted, "language-models").collect()}
    total = sum(r["count"] for r in counts if r["lang"] in found)
    names = tuple(sorted(found))
    of = {r["lang"]: r["count"] for r in counts}
    if not names:
        return LanguageModel((), (), np.zeros((1, 0)), params)
    return LanguageModel(names, tuple(math.log(of[x] / total) for x in names), np.array([found[x] for x in names]).T, params)


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, score for every whole text.

    ``score`` is the posterior of the predicted language; ties go to the first in code-point order. A
    null text, one without a letter, or a model without languages gives ``und`` and 0. Columns of
    ``docs`` named lang_pred or score are only kept if they are not in ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((load_pieces(model.params.vocabulary), model.languages, model.priors, model.logs))
    schema = docs.select(*keep).schema.simpleString()[7:-1]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches):
        pieces, languages, priors, logs = shared.value
        lattice = PieceLattice(pieces)
        row_of: dict[str, int] = {}
        table = np.zeros((0, len(languages)))
        for batch in row_slices(batches, at):
            texts = [t.split() if languages and t and any(map(str.isalpha, t)) else None for t in batch.column(at).to_pylist()]
            if len(row_of) > CACHE:
                row_of, table = {}, table[:0]
            new = list(dict.fromkeys(w for words in texts for w in words or () if w not in row_of))
            parts = [word_scores(lattice, ["▁" + w for w in new[i : i + AT_ONCE]], logs) for i in range(0, len(new), AT_ONCE)]
            row_of.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
            table = np.concatenate([table, *parts])
            named, scores = [], []
            for words in texts:
                if words is None:
                    named.append("und")
                    scores.append(0.0)
                    continue
                total = table[[row_of[w] for w in words]].sum(axis=0) + priors
                top = int(np.argmax(total))
                named.append(languages[top])
                scores.append(1.0 / float(np.exp(total - total[top]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(named), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, *[F.col("text").alias("_text")] * ("text" not in keep)).mapInArrow(run, f"{schema}, lang_pred string, score double")


def in_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``fold``; a null id never is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == fold, F.lit(False))
