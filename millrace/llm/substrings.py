"""Remove passages that stand earlier in the corpus, by an FM-index for each shard.

A window is a number of consecutive words of one document. Windows are dealt to shards by their
minimizer, the least hash among their runs of a few words: equal windows have the same one. Consecutive windows
of one minimizer travel as one span. Equal spans are matched by hash, and all but the first are removed;
what differs but shares a minimizer goes with its words to a shard, whose FM-index tells which windows
occur earlier.

A minimizer with very many spans is broken up into its single windows from the start, each of them a span with a
minimizer of its own, so no shard grows with one passage's popularity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.fm_index import FMIndex
from millrace.llm.hashing import Words, mix64, prefix_sums, run_hashes, words_of
from millrace.session import materialise

PLACE_BITS = 26  # words of one chunk or document: below 2**26
SPAN, REMOVED = 0, 1
SKETCH_BITS = 14


@dataclass(frozen=True)
class SubstringParams:
    """``window`` words must agree; minimizers are of ``gram`` words. Minimizers with more than ``most_spans``
    different spans are broken up; of those that the sketch of counts does not show, at most ``index_spans`` spans go
    into an index. ``index_words`` is the size at which an index is built from the shard's spans."""

    window: int = 20
    gram: int = 5
    most_spans: int = 4000
    index_spans: int = 16_000
    index_words: int = 400_000
    shard_words: int = 2_000_000


def spans_of(words: Words, params: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, last window, row) of the spans: runs of windows whose minimizer stands at the same place."""
    w, reach = params.window, params.window - params.gram + 1
    n = len(words.starts)
    row_end = np.repeat(words.first[1:], np.diff(words.first))
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    valid = np.arange(n) + w <= row_end
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    grams, _ = words.windows(params.gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~mask) | np.arange(n, dtype=np.uint64)  # ties: the first place
    size = 1
    while size < reach:  # least of the next ``size`` places, by doubling
        step = min(size, reach - size)
        later = np.append(least[step:], np.full(step, ~np.uint64(0)))
        least = np.minimum(least, later)
        size += step
    place = (least & mask).astype(np.int64)
    at = np.flatnonzero(valid)
    new = np.append(True, (place[at][1:] != place[at][:-1]) | (np.diff(at) != 1) | (row[at][1:] != row[at][:-1]))
    begins = np.flatnonzero(new)
    first, last = at[begins], at[np.append(begins[1:], len(at)) - 1]
    return grams[place[first]], first, last, row[first]


def broken_up(key, content, first, last, row, words: Words, hot: np.ndarray | None, params: SubstringParams):
    """Spans of crowded minimizers as single windows with the window's hash as key and content."""
    if hot is None:
        return key, content, first, last, row
    crowded = hot[_bucket(key, hot)]
    if not crowded.any():
        return key, content, first, last, row
    count = (last - first + 1)[crowded]
    single = np.repeat(first[crowded], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes = run_hashes(prefix_sums(words.hashes), single, single + params.window)
    rest = ~crowded
    return (np.append(key[rest], hashes), np.append(content[rest], hashes), np.append(first[rest], single), np.append(last[rest], single), np.append(row[rest], np.repeat(row[crowded], count)))


def _bucket(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (mix64(key) >> np.uint64(64 - int(len(table)).bit_length() + 1)).astype(np.intp)


def batch_spans(ids: np.ndarray, column: pa.Array, hot: np.ndarray | None, params: SubstringParams):
    """(key, content, doc_id, start, windows, repeated) of a batch; ``repeated`` marks spans of which the batch has an earlier one."""
    parts = []
    for a, _, words in words_of(column):
        key, first, last, row = spans_of(words, params)
        content = run_hashes(prefix_sums(words.hashes), first, last + params.window)
        key, content, first, last, row = broken_up(key, content, first, last, row, words, hot, params)
        parts.append((key, content, ids[a + row], first - words.first[row], last - first + 1))
    key, content, doc, start, count = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    order = np.lexsort((start, doc, content, key))
    key, content, doc, start, count = key[order], content[order], doc[order], start[order], count[order]
    again = np.append(False, (key[1:] == key[:-1]) & (content[1:] == content[:-1]))[: len(key)]
    # Rows of the same place are not repeats of each other.
    group = np.cumsum(~again) - 1
    opens = np.flatnonzero(~again)
    repeated = (doc != doc[opens][group]) | (start != start[opens][group]) if len(key) else again
    return key, content, doc, start, count, repeated


def covered(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (doc, start, count) put together where they meet or overlap."""
    if not len(doc):
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + count)[order]
    new_doc = np.append(True, doc[1:] != doc[:-1])
    group = np.cumsum(new_doc) - 1
    shift = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(end + group * shift) - group * shift
    new = new_doc | np.append(True, start[1:] > reach[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(doc)) - 1
    return doc[begins], start[begins], reach[ends] - start[begins]


def _crowded(docs: DataFrame, params: SubstringParams) -> np.ndarray | None:
    """Table of hash buckets of minimizers, true where they have so many spans that they are to be broken up: more than
    ``most_spans``, and eight times the mean bucket. Equal spans of a batch count once."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    most = max(params.most_spans, -(-8 * (chars // 50) // (1 << SKETCH_BITS)))

    def sketch(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            key, _, _, _, _, repeated = batch_spans(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), None, params)
            counts += np.bincount(_bucket(key[~repeated], counts), minlength=1 << SKETCH_BITS)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(counts[filled])], ["bucket", "n"])

    rows = docs.mapInArrow(sketch, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    found = [r["bucket"] for r in rows.select("bucket").collect()]
    if not found:
        return None
    table = np.zeros(1 << SKETCH_BITS, bool)
    table[found] = True
    return table


def _emit(kind, key, content, doc, start, count) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(start << 8 | np.minimum(count, 255) if kind == SPAN else start << 32 | count)],
        ["kind", "key", "content", "doc_id", "place"])


def _deal_spans(hot, params: SubstringParams):
    def run(batches):
        for batch in batches:
            key, content, doc, start, count, repeated = batch_spans(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), hot.value, params)
            new = ~repeated
            yield _emit(SPAN, key[new], content[new], doc[new], start[new], count[new])
            d, s, c = covered(doc[repeated], start[repeated], count[repeated])
            yield _emit(REMOVED, mix64(d.view(np.uint64)), np.zeros(len(d), np.uint64), d, s, c)

    return run


def _match_spans(params: SubstringParams):
    """Over rows in order of (kind, key, content, doc_id, place): equal spans after the first are removed, and the
    firsts of keys with several contents are asked for as spans."""

    def run(batches: Iterator[pa.RecordBatch]):
        last = None  # (key, content, doc, place) of the first span of the current content
        pending = None  # first span of the current key, while it has one content
        for batch in batches:
            kind, key, content, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            old = kind == REMOVED
            yield _out(REMOVED, key[old], doc[old], place[old] >> 32, place[old] & 0xFFFFFFFF)
            key, content, doc, place = key[~old], content[~old], doc[~old], place[~old]
            if not len(key):
                continue
            if last is not None:  # carry the current content's first span over
                key, content, doc, place = (np.append(np.array([v], np.int64), c) for v, c in zip(last, (key, content, doc, place), strict=True))
            opens = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
            group = np.cumsum(opens) - 1
            at = np.flatnonzero(opens)
            head_doc, head_place = doc[at][group], place[at][group]
            again = (doc != head_doc) | (place >> 8 != head_place >> 8)
            yield _out(REMOVED, key[again], doc[again], place[again] >> 8, place[again] & 255)
            # Firsts of the contents: asked for if the key has another content before or after.
            k, d, p = key[at], doc[at], place[at]
            if last is not None and pending is None:
                fresh = np.arange(len(k)) > 0  # the carried span was asked for already
            else:
                fresh = np.ones(len(k), bool)
            same_before = np.append(last is not None and pending is None, k[1:] == k[:-1])
            same_after = np.append(k[1:] == k[:-1], False)
            ask = (same_before | same_after) & fresh
            yield _out(SPAN, k[ask], d[ask], p[ask] >> 8, p[ask] & 255)
            i = at[-1]
            last = (key[i], content[i], doc[i], place[i])
            pending = None if bool(same_before[-1]) or (len(k) == 1 and not fresh[0]) else last

    return run


def _out(kind, key, doc, start, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), pa.array(key.astype(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["kind", "key", "doc_id", "start", "n"])


def _loose_windows(window: int):
    """The single windows of the asked spans of each document, as spans with the window's hash as key and content."""

    def run(batches):
        for batch in batches:
            asked = batch.column(2).to_pylist()
            for a, _, words in words_of(batch.column(1)):
                for row in range(len(words.first) - 1):
                    spans = [np.arange(x["start"], x["start"] + x["n"]) for x in asked[a + row]]
                    start = np.concatenate(spans).astype(np.int64)
                    at = start + words.first[row]
                    hashes = run_hashes(prefix_sums(words.hashes), at, at + window)
                    yield _emit(SPAN, hashes, hashes, np.full(len(at), batch.column(0)[a + row].as_py(), np.int64), start, np.ones(len(at), np.int64))

    return run


def _cut_spans(window: int):
    """Words of the asked spans of each document: (key, doc_id, start, words)."""

    def run(batches):
        for batch in batches:
            for doc, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.encode().split()
                rows = [(x["key"], doc, x["start"], b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1])) for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "doc_id", "start", "words"])

    return run


def earlier_windows(spans: list[tuple[int, int, bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, start) of the windows of ``spans`` (doc_id, start, words) that also start earlier in one of them."""
    numbers: dict[bytes, int] = {}
    spans = sorted(spans)
    sequences = [np.array([numbers.setdefault(w, len(numbers)) for w in words.split(b" ")], np.int64) for _, _, words in spans]
    index = FMIndex(sequences)
    counts = np.array([len(s) - window + 1 for s in sequences], np.int64)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(index.first, counts) + offset
    which, low, high = index.search_repeated(starts, window)
    # The windows' places in order of (doc_id, start), and the least of each range of equal windows.
    doc = np.repeat(np.array([s[0] for s in spans], np.int64), counts)
    word = np.repeat(np.array([s[1] for s in spans], np.int64), counts) + offset
    in_order = np.lexsort((word, doc))
    new = np.append(True, (doc[in_order][1:] != doc[in_order][:-1]) | (word[in_order][1:] != word[in_order][:-1]))
    number = np.empty(len(doc), np.int64)
    number[in_order] = np.cumsum(new)  # windows of the same place have the same number
    by_place = np.full(len(index.text), np.iinfo(np.int64).max)
    by_place[starts] = number
    ranked = np.append(by_place[index.order], np.iinfo(np.int64).max)
    ranges, of = np.unique(low, return_inverse=True)
    ends = np.empty(len(ranges), np.int64)
    ends[of] = high
    least = np.minimum.reduceat(ranked, np.ravel(np.column_stack([ranges, ends])))[::2] if len(ranges) else ranges
    repeated = which[number[which] > least[of]]
    return doc[repeated], word[repeated]


def _search_shards(params: SubstringParams):
    """Over (key, doc_id, start, words) in order of key: an index over whole keys of about index_words words each."""

    def found(spans):
        doc, start = earlier_windows(spans, params.window)
        doc, start, count = covered(doc, start, np.ones(len(doc), np.int64))
        return _out(REMOVED, np.zeros(len(doc), np.int64), doc, start, count).select(["doc_id", "start", "n"])

    def run(batches):
        spans, size, current = [], 0, None
        for batch in batches:
            for key, doc, start, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != current and size >= params.index_words:
                    yield found(spans)
                    spans, size = [], 0
                current = key
                spans.append((doc, start, words))
                size += words.count(b" ") + 1
        if spans:
            yield found(spans)

    return run


def keep_words(text: str | None, runs: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """(number of words, words that no removed window covers)."""
    words = (text or "").encode().split()
    n = len(words)
    if runs:
        gone = np.zeros(n + 1, np.int64)
        at = np.array([(r["start"], r["start"] + r["n"] + window - 1) for r in runs], np.int64)
        np.add.at(gone, np.minimum(at[:, 0], n), 1)
        np.add.at(gone, np.minimum(at[:, 1], n), -1)
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return n, words


def _digests(window: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, words = keep_words(text, runs, window)
                out.append((doc, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cut_texts(window: int, at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                texts.append(b" ".join(keep_words(text, runs, window)[1]).decode() if runs else text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


SPAN_ROWS = "kind tinyint, key bigint, content bigint, doc_id bigint, place bigint"
MATCH_ROWS = "kind tinyint, key bigint, doc_id bigint, start int, n int"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_own``, a number for each document with a text, in the order of (doc_id, hash of the text), null ids first.

    The doc_id itself is that number where none is null and none has different texts. Otherwise the distinct (doc_id, hash) are
    sorted in ranges, and the documents written once with the place of theirs."""
    own = F.col("doc_id").cast("bigint")
    per = docs.where("text IS NOT NULL").groupBy(own.alias("_id")).agg((F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("several"))
    if not per.where("_id IS NULL OR several").limit(1).count():
        return docs.withColumn("_own", own)
    marked = docs.withColumn("_id", own).withColumn("_mark", F.md5(F.col("text").cast("binary")))
    keys = marked.where("text IS NOT NULL").select("_id", "_mark").distinct()
    order = (F.col("_id").asc_nulls_first(), F.col("_mark"))
    # The numbers rise with the partition and the row in it.
    places = materialise(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_own", F.monotonically_increasing_id()), "document-places")
    places = places.withColumnsRenamed({"_id": "_place_id", "_mark": "_place_mark"})
    met = F.col("_id").eqNullSafe(F.col("_place_id")) & (F.col("_mark") == F.col("_place_mark"))
    return materialise(marked.join(places, met, "left").select(*docs.columns, "_own"), "numbered-documents")


def with_removals(docs: DataFrame, params: SubstringParams) -> DataFrame:
    """``docs`` with ``_runs``, the windows (start, n) to remove: n windows from word ``start`` on; null without any."""
    spark = docs.sparkSession
    docs = numbered(docs)
    plain = docs.where("text IS NOT NULL").select(F.col("_own").alias("doc_id"), "text")
    hot = spark.sparkContext.broadcast(_crowded(plain, params))
    order = lambda rows: rows.repartition("key").sortWithinPartitions("kind", "key", "content", "doc_id", "place")
    rows = plain.mapInArrow(_deal_spans(hot, params), SPAN_ROWS)
    matched = materialise(order(rows).mapInArrow(_match_spans(params), MATCH_ROWS), "matched-spans")

    asked = matched.where(F.col("kind") == SPAN)
    removed = matched.where(F.col("kind") == REMOVED).select("doc_id", "start", "n")
    with_asked = lambda rows: plain.join(rows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n")).alias("asked")), "doc_id").select("doc_id", "text", "asked")

    # Keys with too many different spans for one index: their windows are matched by hash alone.
    crowded = materialise(asked.groupBy("key").agg(F.count("*").alias("spans"), F.sum(F.col("n") + params.window - 1).alias("words")), "asked-keys")
    loose = crowded.where(F.col("spans") > params.index_spans).select("key")
    if loose.limit(1).count():
        windows = with_asked(asked.join(loose, "key", "left_semi")).mapInArrow(_loose_windows(params.window), SPAN_ROWS)
        found = order(windows).mapInArrow(_match_spans(params), MATCH_ROWS).where(F.col("kind") == REMOVED)
        removed = removed.unionByName(materialise(found.select("doc_id", "start", "n"), "loose-matches"))
        asked = asked.join(loose, "key", "left_anti")
    words = crowded.where(F.col("spans") <= params.index_spans).agg(F.sum("words")).first()[0] or 0
    if words:
        cut = with_asked(asked).mapInArrow(_cut_spans(params.window), "key bigint, doc_id bigint, start int, words binary")
        shards = max(spark.sparkContext.defaultParallelism, -(-words // params.shard_words))
        found = cut.repartition(int(shards), "key").sortWithinPartitions("key").mapInArrow(_search_shards(params), "doc_id bigint, start int, n int")
        removed = removed.unionByName(materialise(found, "index-matches"))
    runs = removed.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    return docs.join(runs, F.col("_own") == F.col("_id"), "left").drop("_id", "_own")


def remove_repeats(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text).

    Every word goes that is covered by a window whose words also start earlier: in a smaller doc_id, or before in
    the same document. Windows are judged on the input, not on what is left. Null and empty
    texts have no words; the kept words are joined by one space. Rows of one doc_id and text count as one
    document and are treated alike; different texts of one doc_id are documents of their own, in the order of the texts'
    md5. Null ids come before all others, by the same rule. An empty table gives no rows; other columns are ignored.
    """
    rows = with_removals(docs.select("doc_id", "text"), params).select("doc_id", "text", "_runs")
    return rows.mapInArrow(_digests(params.window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and others) with the words of ``remove_repeats`` cut from the texts, and n_chars to
    match, and any other columns as they are. A text that loses words has single spaces between the others; one that loses none is left as it is."""
    names = docs.columns
    # Under names of their own, the caller's columns can't meet the ones made here.
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(names)])
    rows = with_removals(inner, params).select(*inner.columns, "_runs")
    cut = rows.mapInArrow(_cut_texts(params.window, names.index("text"), names), docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in names else cut
