"""Clusters, importance resampling and the n-gram join against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from millrace.llm import clustering, ngram_join, resampling

# --- clusters


def brute_clusters(rows, params):
    kept = [(i, [math.floor(params.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == params.dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{params.seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[: params.k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(params.rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in last:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in last)


def vectors(spark, rows):
    kind = "vec_id bigint, embedding array<float>, label int, cluster string, id string, v int, near string"
    return spark.createDataFrame([(i, v, 1, "x", "y", 2, "z") for i, v in rows], kind)


@pytest.mark.parametrize(("k", "rounds"), [(5, 4), (60, 2), (1, 0)])
def test_clusters(spark, k, rounds):
    rng = random.Random(3)
    params = clustering.ClusterParams(k=k, rounds=rounds, dims=6)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    # Components of 1/64, so that floats are exact and distances tie.
    rows = [(i, [round(64 * (m + rng.uniform(-0.2, 0.2))) / 64 for m in rng.choice(middles)]) for i in range(50)]
    rows += [(100, None), (101, [0.5] * 5), (102, [0.5] * 7), (103, [0.5] * 5 + [None]), (104, [math.nan] + [0.5] * 5), (105, [math.inf] * 6), (106, [])]
    rows += [rows[0], rows[0], (0, [0.25] * 6), (None, [0.25] * 6), (None, [-0.125] * 6)]
    got = clustering.cluster_vectors(vectors(spark, rows).repartition(3), params)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, params)


def test_clusters_of_no_vectors(spark):
    for rows in ([], [(1, None)], [(None, [0.5] * 64)]):
        got = clustering.cluster_vectors(vectors(spark, rows))
        assert got.count() == 0 and len(got.columns) == 6


def test_components_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="overflow"):
        clustering.cluster_vectors(vectors(spark, [(1, [3e30] * 64)])).collect()


def test_cluster_plan_has_no_python(spark):
    params = clustering.ClusterParams(dims=2)
    rows = clustering.whole_vectors(vectors(spark, [(1, [0.5, 1.0])]), params, "vec_id", "embedding")
    plan = rows.select(clustering.nearest("v", [[1, 2], [3, 4]])["cluster"])._jdf.queryExecution().toString()
    assert "zip_with" in plan and "[3,4]" in plan and "Python" not in plan and "Arrow" not in plan


# --- resampling


def brute_features(text, longest):
    clean = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isascii() and c.isalnum() or c > "\x7f" else " " for c in clean).split(" ")
    words = [w for w in words if w]
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, p):
    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    docs = [(i, t, *brute_features(t, p.longest)) for i, t in rows]
    s = Counter(bucket(f) for *_, fs in docs for f in fs)
    t = Counter(bucket(f) for text in target for f in brute_features(text, p.longest)[1])
    all_s, all_t = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + p.buckets) / ((s[b] + 1) * (all_t + p.buckets))))
    scored = []
    for i, _, n, fs in docs:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= p.least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return scored, able[: len(able) * p.percent // 100]


ODD = ["Ünïcode WORDS: ÀB, don't x-1 'q' zZ", "ab" * 40 + " " + "ab" * 40, "", None, "...", "word"]


@pytest.mark.parametrize("params", [
    resampling.ResampleParams(buckets=97, least_words=5, percent=30), resampling.ResampleParams(buckets=50, least_words=5, longest=2, head_words=3, head_pairs=2),
    resampling.ResampleParams(buckets=1000, least_words=0, percent=100, longest=4, head_words=0, head_pairs=0), resampling.ResampleParams(percent=0)])
def test_resampling(docs_of, rng, make_text, params, monkeypatch):
    monkeypatch.setattr(resampling, "SEGMENT", 50)
    rows = [(i * 7 % 101, make_text(rng, rng.randrange(30)) + rng.choice((" The End", ".", " été"))) for i in range(80)]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [rows[3], (None, rows[4][1]), (None, rows[5][1]), (None, None)]
    target = [make_text(rng, 25) for _ in range(6)] + [None, "", "The end"]
    out = resampling.resample(docs_of(rows).repartition(4), docs_of(list(enumerate(target))), params)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = out.collect()
    scored, drawn = brute_resample(rows, target, params)
    assert Counter(tuple(r)[:4] for r in got) == Counter((i, n, w, x) for i, _, n, w, x in scored)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(x[0], x[4]) for x in drawn]


def test_resampling_of_no_rows(docs_of):
    assert resampling.resample(docs_of([]), docs_of([(1, "a")])).count() == 0
    got = resampling.resample(docs_of([(1, "a b"), (2, None)]), docs_of([]), resampling.ResampleParams(least_words=1, percent=100)).collect()
    assert {r["doc_id"]: r["rank"] for r in got} == {1: 1, 2: None}


def test_long_text_in_segments(monkeypatch, rng, make_text):
    text = make_text(rng, 400).encode() + b" " + b"x" * 300 + b" end"
    whole = next(resampling.segments(text, 2))[0]
    monkeypatch.setattr(resampling, "SEGMENT", 64)
    p = resampling.ResampleParams(longest=3)
    vocabulary = resampling.Vocabulary([b"the", b"of"], [(b"the", b"of")], p)
    pieces = [vocabulary.buckets(words, known) for words, known in resampling.segments(text, 2)]
    assert len(pieces) > 10 and Counter(b for x in pieces for b in x) == Counter(vocabulary.buckets(whole))


def test_numbering_of_tied_rows(spark):
    """Rows that differ in nothing but their written number are spread over tasks and numbered without gaps."""
    rows = spark.range(500).selectExpr("1 AS score", "id AS row").repartition(4)
    got = resampling.numbered(rows, [resampling.F.col("score").desc(), resampling.F.col("row").asc()], "rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert all(r["rank"] == r["row"] + 1 for r in got)


# --- n-gram join


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_join(rows, percent=80):
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    near = [[b for b in range(len(rows)) if b != a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])] for a in range(len(rows))]
    out = Counter()
    for a, (i, t) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[i, len(shingles(t)), None if i is None else min(rows[b][0] for b in seen), None if i is None else len(near[a])] += 1
    return out


@pytest.fixture(scope="module")
def alike(rng, make_text):
    rows = []
    for group in range(20):
        base = make_text(rng, rng.choice((9, 40, 90))).split()
        for _ in range(rng.randrange(1, 10)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
            rows.append(" ".join(words) + (" a passage that stands in a great many of the texts here" if group % 2 else ""))
    rows += ["One", "one", "ONE two", "one  two", "", "", None, rows[0], rows[0].upper(), "a b a b a b a b a b", "a b a b a b", "b a b a b a"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("params", [ngram_join.JoinParams(), ngram_join.JoinParams(block_shingles=300), ngram_join.JoinParams(block_shingles=40, skip=5.0), ngram_join.JoinParams(percent=50, block_shingles=200), ngram_join.JoinParams(percent=100)])
def test_ngram_join(docs_of, alike, params):
    got = ngram_join.jaccard_join(docs_of(alike).repartition(5), params)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert Counter(map(tuple, got.collect())) == brute_join(alike, params.percent)


def test_ngram_join_of_odd_rows(docs_of, make_text, rng):
    text = make_text(rng, 30)
    rows = [(3, text), (3, text), (3, make_text(rng, 20)), (9, text + " more"), (None, text), (None, None), (5, None), (2, ""), (4, text.upper()), (8, make_text(rng, 20000)), (-7, text)]
    assert Counter(map(tuple, ngram_join.jaccard_join(docs_of(rows)).collect())) == brute_join(rows)
    assert ngram_join.jaccard_join(docs_of([])).count() == 0


def test_one_large_group_in_blocks(docs_of, rng, make_text):
    """A chain in which only neighbours are linked, and a star, both larger than a block."""
    base = make_text(rng, 60).split()
    chain = [(i, " ".join(base[i : i + 40])) for i in range(20)]
    star = [(100 + i, " ".join(base[:30] + [f"x{j}" for j in range(i % 7)])) for i in range(60)]
    rows = chain + star
    params = ngram_join.JoinParams(block_shingles=128)
    assert Counter(map(tuple, ngram_join.jaccard_join(docs_of(rows), params).collect())) == brute_join(rows)


def test_search_finds_all_links():
    rng = np.random.Generator(np.random.PCG64(9))
    universe = rng.integers(0, 2**63, 300, dtype=np.uint64)
    base = universe[:60]
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 60), replace=False), rng.choice(universe, rng.integers(0, 20))])) for _ in range(120)]
    lists = ngram_join.Lists(sets)
    for percent in (40, 60, 80):
        for skip in (0.0, 0.01, 1.0, 50.0):
            for i in range(0, 120, 7):
                want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(s, sets[i])) >= percent * len(np.union1d(s, sets[i]))]
                assert sorted(lists.search(sets[i], percent, skip).tolist()) == want


def test_closed_nodes_have_no_links(docs_of, alike):
    """Step 2 is exact for any share of counted shingles."""
    for share in (1, 40, 100):
        got = ngram_join.jaccard_join(docs_of(alike), replace(ngram_join.JoinParams(), first_share=share))
        assert Counter(map(tuple, got.collect())) == brute_join(alike)
