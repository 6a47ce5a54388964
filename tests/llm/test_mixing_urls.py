"""Mixing and URL verdicts against plain Python."""

import numpy as np
import pytest

from millrace.llm import mixing, urls

PARAMS = mixing.MixParams(block_words=16, shard_blocks=4)


def targets_by_rounds(sizes, weights=(5, 2, 1), share=1.5):
    """Share by weight, cut at the limit, share the rest anew among the others."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.fixture(scope="module")
def rows(rng, make_text):
    out = [(i, make_text(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(200)]
    return [*out, (200, None, "a"), (201, "", "b"), (202, " \t\n", "c"), (5, out[5][1], out[5][2])]


def test_takes_follow_targets(docs_of, rows):
    found = mixing.mix(docs_of(rows), PARAMS).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    want = targets_by_rounds(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        words = sum(t["n_words"] for t in r["takes"])
        assert words <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += words
    for source, target in want.items():
        assert taken[source] == int(target)
    again = mixing.mix(docs_of(rows[::-1]).repartition(3), PARAMS).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_documents_are_dealt_to_shards(docs_of, rows):
    unique = [r for r in rows if r[0] != 5]
    out = mixing.mixed_documents(docs_of(unique), PARAMS).collect()
    places = {}
    for r in out:
        assert len(r["text"].split()) == r["n_words"]
        places.setdefault(r["shard"], []).append(r["position"])
    assert len(places) > 2
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_tree_keeps_quotas():
    counts = np.array([7, 0, 500, 93])
    leaves = list(mixing.open_tree(counts, 3, 0, 0, 5))
    assert len(leaves) == 32
    assert (sum(c for _, c in leaves) == counts).all()
    assert max(c.sum() for _, c in leaves) - min(c.sum() for _, c in leaves) <= 1


def test_empty_mix(docs_of):
    assert mixing.mix(docs_of([]), PARAMS).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs_of([(1, "a", "x"), (2, "b", "y")]), mixing.MixParams(max_sources=1))


RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("bad.org", "/", "block")]


def page(spark, rows):
    return spark.createDataFrame([(i, u, h, "z", 1.0) for i, u, h in rows], "page_id bigint, url string, html string, rule string, trust double")


def test_rules_and_parts(spark):
    rows = [
        (1, "https://WWW.Example.com/en/a?x#y", None), (2, "http://example.com/fr/", ""), (3, None, None), (4, "nothing", "x"),
        (5, "http://example.com", None), (6, "http://a.b.bad.org/x", ""), (7, "http://a.b.bad.org/x", ""), (8, "ftp://h?q=://z/", None), (9, "http://É.com/A", None),
    ]
    got = {r["page_id"]: r for r in urls.judge_urls(page(spark, rows), RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/a", "example.com/en/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("com/", "allow")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("", "", None)
    assert got[4]["host"] == ""
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("example.com", "", None)
    assert got[6]["rule"] == "bad.org/"
    assert (got[8]["host"], got[8]["path"]) == ("h", "")
    assert got[9]["host"] == "É.com"
    assert urls.judge_urls(page(spark, []), RULES).count() == 0


def test_scores_follow_links(spark):
    link = lambda *hosts: " ".join(f'<a href="//{h}/q">' for h in hosts)
    rows = [
        (1, "http://good.com/", link("near.net")), (2, "http://bad.org/", link("other.net")), (3, "http://spam.net/", link("bad.org", "worse.bad.org")),
        (4, "http://near.net/", ""), (5, "http://other.net/", ""), (6, "http://worse.bad.org/", ""),
    ]
    params = urls.GraphParams(threshold=0.2, tolerance=1e-9, rounds=200)
    got = {r["host"]: r for r in urls.judge_urls(page(spark, rows), RULES, params).collect()}
    hosts = ["good.com", "bad.org", "spam.net", "near.net", "other.net", "worse.bad.org"]
    edges = {("good.com", "near.net"), ("bad.org", "other.net"), ("spam.net", "bad.org"), ("spam.net", "worse.bad.org"), *((h, h) for h in hosts)}
    weight = np.array([[float((a, b) in edges) for b in hosts] for a in hosts])
    forth, back = weight / weight.sum(1, keepdims=True), weight / weight.sum(0, keepdims=True)
    trust_seed, distrust_seed = np.array([1.0, 0, 0, 0, 0, 0]), np.array([0, 1.0, 0, 0, 0, 1.0])
    solve = lambda m, s: np.linalg.solve(np.eye(6) - 0.85 * m, 0.15 * s)
    for host, t, d in zip(hosts, solve(forth.T, trust_seed), solve(back, distrust_seed), strict=True):
        assert got[host]["trust"] == pytest.approx(t, abs=1e-6)
        assert got[host]["distrust"] == pytest.approx(d, abs=1e-6)
    assert got["spam.net"]["verdict"] == "block"
    assert got["near.net"]["verdict"] == got["other.net"]["verdict"] == "allow"
