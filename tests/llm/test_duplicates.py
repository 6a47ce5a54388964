"""Near duplicates, repeated passages and fingerprints against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, near_dedup, substrings
from millrace.llm.components import components
from millrace.llm.fm_index import FMIndex, WaveletMatrix, suffix_order
from millrace.llm.hashing import words_of


def test_words_and_hashes():
    texts = ["a b\nc", "", None, " a\x0bb  ", "é b", "a b"]
    for _, _, words in words_of(pa.array(texts)):
        found = [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
        assert found == [w for t in texts for w in (t or "").encode().split()]
        by_word = {}
        for w, h in zip(found, words.hashes.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (None, 1)], "a bigint, b bigint")
    assert {tuple(r) for r in components(edges).collect()} == {(5, 3), (4, 3), (3, 3), (9, 3), (20, 20), (21, 20)}
    assert components(edges.where("a < 0")).count() == 0


def bag(text, k=5):
    words = text.encode().split()
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)] if words else [])


def brute_classes(rows, params):
    bags = [(i, t, bag(t or "", params.words)) for i, t in rows]
    n = sum(t is not None for _, t, _ in bags)
    seen = Counter(s for _, _, b in bags for s in b)
    bound = max(2, math.ceil(params.frequent * n))
    fall = lambda c: min(1.0, max(0.0, math.log(c / (params.frequent * n)) / math.log(1 / params.frequent)))
    idf = {s: 1 - (1 - params.least_idf) * fall(c) if c >= bound else 1.0 for s, c in seen.items()}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, _, x) in enumerate(bags):
        for j, _, y in bags[:a]:
            if x and y:
                low = sum(min(x[s], y[s]) * idf[s] for s in x if s in y)
                high = sum(v * idf[s] for s, v in x.items()) + sum(v * idf[s] for s, v in y.items()) - low
                if low / high >= params.threshold:
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


@pytest.fixture(scope="module")
def similar(rng, make_text):
    rows = []
    for group in range(25):
        base = make_text(rng, 60).split()
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(60)] = "new" + str(rng.randrange(10**6))
            rows.append(" ".join(words) + (" same passage in a great many of the texts here" if group % 2 else ""))
    rows += ["one", "one", "two words", "", "", rows[0], rows[0]]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("group_size", "fine_from"), [(600, 300), (3, 300), (3, 4)])
def test_near_classes(docs_of, similar, group_size, fine_from):
    params = near_dedup.NearParams(pairs_per_task=2, group_size=group_size, fine_from=fine_from)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs_of(similar), params).collect()}
    assert got == brute_classes(similar, params)


def test_near_classes_of_odd_rows(docs_of):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (None, text), (1, None), (2, ""), (4, text.replace(" ", "  ")), (5, None)]
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_classes(docs_of(rows)).collect())
    assert got == Counter([(3, 3), (3, 3), (None, None), (1, 1), (2, 2), (4, 3), (5, 5)])
    assert near_dedup.near_classes(docs_of([])).count() == 0


def test_samples_estimate_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    a = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    weights = rng.choice([0.75, 1.0, 1.0, 2.0, 3.5], 400)
    other = weights.copy()
    other[rng.permutation(400)[:120]] *= 0.5
    one, two = (near_dedup.weighted_samples(a, w, np.array([0, 400]), 3000, 2)[0] for w in (weights, other))
    assert (one == two).mean() == pytest.approx(near_dedup.weighted_jaccard((a, weights), (a, other)), abs=0.03)


def test_fm_index():
    rng = np.random.Generator(np.random.PCG64(4))
    symbols = rng.integers(0, 11, 300)
    tree = WaveletMatrix(symbols, 11)
    at = rng.integers(0, 301, 200)
    which = rng.integers(0, 11, 200)
    assert (tree.rank(which, at) == [(symbols[:i] == s).sum() for s, i in zip(which, at, strict=True)]).all()
    text = np.append(rng.integers(1, 4, 100), 0)
    assert suffix_order(text).tolist() == sorted(range(101), key=lambda i: text[i:].tolist())
    sequences = [rng.integers(0, 3, n) for n in (30, 1, 12)]
    index = FMIndex(sequences)
    starts = np.concatenate([f + np.arange(len(s) - 3) for f, s in zip(index.first, sequences, strict=True) if len(s) > 3])
    found, low, high = index.search_repeated(starts, 4)
    grams = [tuple(index.text[s : s + 4]) for s in starts]
    count = Counter(grams)
    assert found.tolist() == [i for i, g in enumerate(grams) if count[g] > 1]
    assert [b - a for a, b in zip(low, high, strict=True)] == [count[grams[i]] for i in found]


def brute_removal(rows, window):
    seen, out = {}, []
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            seen[key] = min(seen.get(key, (i, a)), (i, a))
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            if seen[tuple(words[a : a + window])] < (i, a):
                gone[a : a + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def passages(rng, make_text):
    shared = [make_text(rng, n) for n in (20, 25, 40, 19)]
    rows = [(i, make_text(rng, rng.randrange(40)) + " " + rng.choice(shared) + "\n" + make_text(rng, rng.randrange(40))) for i in range(120)]
    rows += [(200 + i, shared[2]) for i in range(5)] + [(300, "la la " * 40), (301, None), (302, ""), (303, "x"), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("params", [substrings.SubstringParams(), substrings.SubstringParams(most_spans=4, index_words=200), substrings.SubstringParams(index_spans=2), substrings.SubstringParams(gram=1, most_spans=60)])
def test_repeated_passages(docs_of, passages, params):
    got = substrings.remove_repeats(docs_of(passages).repartition(5), params).collect()
    assert Counter(map(tuple, got)) == brute_removal(passages, params.window)


def test_texts_without_repeats(docs_of, passages):
    out = substrings.without_repeats(docs_of(passages))
    assert out.columns == docs_of(passages).columns
    kept = {(r["doc_id"], hashlib.sha256(" ".join((r["text"] or "").split()).encode()).hexdigest()) for r in out.collect()}
    assert kept == {(i, h) for i, _, _, h in brute_removal(passages, 20)}
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    assert substrings.remove_repeats(docs_of([])).count() == 0
    assert [r["n_removed"] for r in substrings.remove_repeats(docs_of([(None, "a"), (None, None)])).collect()] == [0, 0]


@pytest.mark.parametrize("params", [substrings.SubstringParams(), substrings.SubstringParams(index_spans=2)])
def test_passages_of_documents_that_share_an_id(docs_of, rng, make_text, params):
    """Texts without an id, or of one id, keep their own words, lose only their own repeats, and may be of any length."""
    shared = make_text(rng, 30)
    rows = [(None, shared + " " + make_text(rng, 40)), (None, make_text(rng, 90) + " " + shared), (None, make_text(rng, 5)), (None, make_text(rng, 60)), (None, None)]
    rows += [(4, make_text(rng, 70) + " " + shared[2:]), (4, make_text(rng, 3)), (4, make_text(rng, 50)), (4, make_text(rng, 30) + " " + shared), (-(2**63), shared)]
    rows += [(i, make_text(rng, i) + " " + shared + " " + make_text(rng, 9)) for i in range(5, 12)] + [rows[0], rows[5]]
    marks = sorted({(i is not None, i or 0, hashlib.md5(t.encode()).hexdigest()) for i, t in rows if t is not None})
    number = lambda i, t: marks.index((i is not None, i or 0, hashlib.md5(t.encode()).hexdigest())) if t is not None else -1
    ids = {number(i, t): i for i, t in rows}
    want = Counter()
    for (n, *rest), count in brute_removal([(number(i, t), t) for i, t in rows], params.window).items():
        want[ids[n], *rest] += count
    got = Counter(map(tuple, substrings.remove_repeats(docs_of(rows).repartition(3), params).collect()))
    assert got == want
    kept = Counter((r["doc_id"], len((r["text"] or "").split())) for r in substrings.without_repeats(docs_of(rows), params).collect())
    assert kept == Counter((i, n - gone) for (i, n, gone, _), count in want.items() for _ in range(count))


def brute_fingerprint(text, bins):
    known, phrase, cuts = set(), "", []
    for at, char in enumerate(text, 1):
        phrase += char
        if phrase not in known:
            known.add(phrase)
            cuts.append(at)
            phrase = ""
    return fingerprints.minimum_hashes(text, cuts + [len(text)] * bool(phrase), bins)


@pytest.mark.parametrize("range_rows", [4000, 3])
def test_fingerprints_of_edited_texts(docs_of, rng, make_text, range_rows):
    rows = [(i * 3, make_text(rng, rng.randrange(80)) + "é☃" * (i % 2)) for i in range(20)] + [(100, ""), (101, None), (102, "a"), (103, "aaaa" * 300)]
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs_of(rows), fingerprints.FingerprintParams(range_rows=range_rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(order)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        mark, other, after = (brute_fingerprint(t, 128) for t in (text, edited, following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.to_text(mark), fingerprints.to_text(other))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(mark, other), fingerprints.likeness(mark, after))


def test_ranges_part_documents_without_an_id(spark, docs_of, rng, make_text):
    """Null ids, and rows of one id, are cut into ranges like others, and each is still met by the next."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, make_text(rng, 12)) for i in range(240)]
    params = fingerprints.FingerprintParams(range_rows=10)
    keys = [(i is not None, i or 0, t) for i, t in rows]
    frame = spark.createDataFrame([(k, i, hash(t) % 10**9) for k, i, t in keys], "known boolean, doc_id bigint, tie bigint")
    limits = fingerprints._ranges(frame, params)
    known, ids, ties = (np.array(c) for c in zip(*[(r["known"], r["doc_id"], r["tie"]) for r in frame.collect()]))
    parts = fingerprints._part_of(known, ids, ties, limits)
    counts = Counter(parts.tolist())
    assert len(counts) >= 20 and max(counts.values()) <= 11
    order = np.lexsort((ties, ids, known))[::-1]
    assert (np.diff(parts[order]) >= 0).all() and parts[order][-1] > parts[order][0]
    many = Counter(map(tuple, fingerprints.edited_likeness(docs_of(rows), params).collect()))
    assert many == Counter(map(tuple, fingerprints.edited_likeness(docs_of(rows)).collect())) and many.total() == 240


def test_fingerprints_of_odd_rows(docs_of):
    rows = [(1, "abc abc"), (1, "abc abc"), (None, "abc abc"), (None, None)]
    out = fingerprints.edited_likeness(docs_of(rows), fingerprints.FingerprintParams(range_rows=1)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter([1, 1, None, None])
    assert len({r["fingerprint"] for r in out if r["n_chars"]}) == 1
    assert fingerprints.edited_likeness(docs_of([])).count() == 0
    assert fingerprints.edited_likeness(docs_of([(4, "ab")])).first()["near_next"] == 1.0
    marks = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs_of([(1, "x y"), (2, "x y"), (3, None)]), ["doc_id"]).collect()}
    assert marks[1] == marks[2] and set(marks[3]) == {"f"}
