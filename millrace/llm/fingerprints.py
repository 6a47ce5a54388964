"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases, each the longest known phrase and one more character. The set of phrases
is what a compressor would keep of the text; its minimum hashes make up the fingerprint, and the
agreement of two fingerprints estimates how far the phrase sets are the same.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import prefix_sums, run_hashes
from millrace.llm.ranking import numbered
from millrace.session import materialise


@dataclass(frozen=True)
class FingerprintParams:
    """``bins`` minimum hashes of 12 bits (three hexadecimal digits each). ``range_rows``: documents that one
    task streams in order to pair each with the next; more where there would be over ``most_ranges`` tasks, as the
    driver keeps one row for each."""

    bins: int = 128
    range_rows: int = 4000
    most_ranges: int = 50_000


class PhraseParser:
    """LZ78 parse in steps: ``read`` goes on from where the last call ended."""

    def __init__(self):
        self.root: dict = {}
        self.node = self.root
        self.at = 0

    def read(self, text: str, added: list | None = None) -> list[int]:
        """End places of the phrases completed in ``text``, which follows what was read before."""
        root, node, cuts = self.root, self.node, []
        for at, char in enumerate(text, self.at + 1):
            child = node.get(char)
            if child is None:
                node[char] = {}
                if added is not None:
                    added.append((node, char))
                cuts.append(at)
                node = root
            else:
                node = child
        self.node, self.at = node, self.at + len(text)
        return cuts


def close(cuts: list[int], length: int) -> list[int]:
    """Add the end of the text, where a last phrase that was known before ends."""
    return cuts if not length or cuts and cuts[-1] == length else [*cuts, length]


def phrase_cuts(text: str) -> list[int]:
    """End places of the LZ78 phrases of ``text``; the last may be a phrase known before."""
    return close(PhraseParser().read(text), len(text))


def minimum_hashes(text: str, cuts: list[int], bins: int) -> np.ndarray:
    """The least hash of the phrases in each bin, -1 for an empty bin; a phrase's hash picks its bin."""
    out = np.full(bins, -1, np.int64)
    if not cuts:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.array(cuts, np.int64)
    hashes = run_hashes(prefix_sums(points.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(1)), np.append(0, ends[:-1]), ends)
    hashes = np.sort(hashes)
    bin_of = (hashes >> np.uint64(32)).astype(np.int64) * bins >> 32
    first = np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1]))
    out[bin_of[first]] = ((hashes[first] & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)).astype(np.int64) % 4095
    return out


def to_text(hashes: np.ndarray) -> str:
    return "".join([f"{x:03x}" if x >= 0 else "fff" for x in hashes.tolist()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fills; two texts without phrases are alike."""
    filled = int(((a >= 0) | (b >= 0)).sum())
    return int(((a == b) & (a >= 0)).sum()) / filled if filled else 1.0


def fingerprint(text: str, bins: int) -> np.ndarray:
    return minimum_hashes(text, phrase_cuts(text), bins)


def fingerprints(docs: DataFrame, keep: list[str], params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text) with ``fingerprint``; a null text counts as empty, equal texts
    have equal fingerprints, that of an empty one is all f."""
    schema = docs.select(*keep).schema.simpleString()[7:-1]

    def run(batches):
        for batch in batches:
            marks = [to_text(fingerprint(t or "", params.bins)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(marks, pa.string())], [*keep, "fingerprint"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, fingerprint string")


class _Document:
    """A document waiting for the next one. Its edited text begins as it does, so the parse of that part is kept."""

    def __init__(self, text: str, bins: int):
        self.text, self.bins = text, bins
        self.tail = len(text) // 2
        self.parser = PhraseParser()
        self.head_cuts = self.parser.read(text[: len(text) - self.tail])
        node, at, added = self.parser.node, self.parser.at, []
        rest = self.parser.read(text[len(text) - self.tail :], added)
        for parent, char in reversed(added):
            del parent[char]
        self.parser.node, self.parser.at = node, at
        self.mark = minimum_hashes(text, close(self.head_cuts + rest, len(text)), bins)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """(edited text, its minimum hashes); to be called once."""
        new = following[: self.tail]
        text = self.text[: len(self.text) - self.tail] + new
        return text, minimum_hashes(text, close(self.head_cuts + self.parser.read(new), len(text)), self.bins)


ORDER = ("known", "doc_id", "tie")


Limits = tuple[np.ndarray, np.ndarray, np.ndarray]  # hashes among null ids; ids and hashes among the others


def _part_of(known: np.ndarray, doc_id: np.ndarray, tie: np.ndarray, limits: Limits) -> np.ndarray:
    """Number of a row's range. Ranges count from the largest ids, and null ids lie in the last ones; rows without an id, and of one
    id, are cut by their texts' hashes."""
    null_ties, ids, ties = limits
    at = np.searchsorted(null_ties, tie, "right").astype(np.int64)
    low, high = np.searchsorted(ids, doc_id, "left"), np.searchsorted(ids, doc_id, "right")
    place = high.astype(np.int64)
    for a, b in {(int(a), int(b)) for a, b in zip(low[low < high], high[low < high], strict=True)}:
        same = (low == a) & (high == b)
        place[same] = a + np.searchsorted(ties[a:b], tie[same], "right")
    return len(null_ties) + len(ids) - np.where(known, len(null_ties) + place, at)


def _ranges(keys: DataFrame, params: FingerprintParams) -> Limits:
    """Limits of ranges of about range_rows rows: one key for each task to come, from the sorted keys."""
    rows = keys.count()
    each = max(params.range_rows, -(-rows // params.most_ranges))
    found = []
    if rows > each:
        order = [F.col(c).asc() for c in (*ORDER, "row")]
        placed = numbered(keys.withColumn("row", F.monotonically_increasing_id()), order, "place")
        found = sorted(tuple(r) for r in placed.where(F.col("place") % each == 0).select(*ORDER).distinct().collect())
    known = [k for k in found if k[0]]
    return tuple(np.array(x, np.int64) for x in ([t for k, _, t in found if not k], [i for _, i, _ in known], [t for *_, t in known]))


def edited_likeness(docs: DataFrame, params: FingerprintParams = FingerprintParams()) -> DataFrame:
    """Compare each document of (doc_id, text) with an edited form of itself and with the next document.

    Documents are in order of falling doc_id, null ids last, rows of one id by their text's hash; after the
    last comes the first. The edited text has its last n // 2 characters replaced by the first as many of
    the next document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Null texts count as empty; a lone document is its own next one. An
    empty table gives no rows; other columns are ignored. A text may be of any length; its phrases are held by one task.

    Each range of keys (id and hash of the text, so that documents without an id or of one id are parted too) goes to one task, with the first row of the next range besides; so every text is
    shuffled once, and tasks share nothing.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    keys = materialise(rows.select(*ORDER), "document-keys")
    limits = _ranges(keys, params)

    def first_of(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            known, ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            parts = _part_of(known, ids, ties, limits)
            order = np.lexsort((ties, ids, known, parts))
            last = np.flatnonzero(np.append(parts[order][1:] != parts[order][:-1], True)) if len(order) else order
            for i in order[last]:
                key = (bool(known[i]), int(ids[i]), int(ties[i]))
                best[int(parts[i])] = max(best.get(int(parts[i]), key), key)
        found = sorted(best.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in found], pa.int64()), *[pa.array([k[i] for _, k in found], kind) for i, kind in enumerate((pa.bool_(), pa.int64(), pa.int64()))]], ["part", *ORDER])

    firsts = keys.mapInArrow(first_of, "part bigint, known boolean, doc_id bigint, tie bigint")
    firsts = firsts.groupBy("part").agg(F.max(F.struct(*ORDER)).alias("key")).orderBy("part").collect()  # one row for each range
    filled = [r["part"] for r in firsts]
    before = {tuple(r["key"]): filled[i - 1] for i, r in enumerate(firsts)}  # the first range follows the last
    shared = spark.sparkContext.broadcast((limits, before))

    def deal(batches):
        ends, previous = shared.value
        for batch in batches:
            known, ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            parts = _part_of(known, ids, ties, ends)
            copies = [i for i, key in enumerate(zip(known.tolist(), ids.tolist(), ties.tolist(), strict=True)) if key in previous]
            to = [previous[(bool(known[i]), int(ids[i]), int(ties[i]))] for i in copies]
            for rows, part, extra in ((batch, parts, False), (batch.take(pa.array(copies, pa.int64())), np.array(to, np.int64), True)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.full(rows.num_rows, extra)), *rows.columns], ["part", "extra", *ORDER, "text"])

    dealt = rows.mapInArrow(deal, "part bigint, extra boolean, known boolean, doc_id bigint, tie bigint, text string")
    dealt = dealt.repartition(max(1, len(filled)), "part").sortWithinPartitions("part", "extra", *[F.desc(c) for c in ORDER])

    def compare(batches):
        held, held_part, held_id = None, None, None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]
            for part, extra, known, doc_id, text in zip(*columns, strict=True):
                if part != held_part:
                    held = None
                elif extra and held is None:
                    continue  # a repeated row's copy
                now = _Document(text, params.bins)
                if held is not None:
                    edited, mark = held.edited(text)
                    out.append((held_id, len(held.text), hashlib.sha256(edited.encode()).hexdigest(), to_text(held.mark), to_text(mark), likeness(held.mark, mark), likeness(held.mark, now.mark)))
                held, held_part, held_id = (None if extra else now), part, (doc_id if known else None)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names)

    return dealt.mapInArrow(compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
