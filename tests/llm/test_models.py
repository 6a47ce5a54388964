"""Toxicity, languages, licenses, leaks and language-model scores on small fixtures."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import backoff_lm, decontaminate, language, licenses, toxicity

BAD = ("vile", "rotten")


@pytest.fixture(scope="module")
def labelled(rng, make_text):
    rows, marks = [], {}
    for i in range(400):
        sentences = [make_text(rng, rng.randrange(4, 9)) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(BAD) + rng.choice(("", "ness"))
        rows.append((i, ". ".join(sentences)))
        marks[i] = int(i % 3 == 0)
    return rows, marks


def test_toxicity(spark, docs_of, labelled):
    rows, marks = labelled
    train = [(i, t) for i, t in marks.items() if i % 5]
    labels = spark.createDataFrame([*train, (None, 1), (399, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs_of(rows), labels)
    extra = [(1000, None), (1001, ""), (1002, "..."), (1003, rows[0][1]), (0, rows[0][1])]
    got = toxicity.score_toxicity(docs_of(rows + extra), model, ["doc_id", "score"]).drop("score").columns
    assert got == ["doc_id", "predicted", "offending"]
    out = toxicity.score_toxicity(docs_of(rows + extra), model, ["doc_id"]).collect()
    assert len(out) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in out}
    right = [by_id[i]["predicted"] == marks[i] for i, _ in rows if i % 5 == 0]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert by_id[1000]["score"] == by_id[1001]["score"] == by_id[1002]["score"] == 0.0
    assert by_id[1003]["score"] == by_id[0]["score"]
    texts = dict(rows)
    for i in range(0, 400, 15):
        spans = by_id[i]["offending"]
        assert spans and all(any(b in texts[i][s["start"] : s["end"]] for b in BAD) for s in spans)
    assert toxicity.score_toxicity(docs_of([]), model, ["doc_id"]).count() == 0


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs_of([(1, "a")]), none)
    assert toxicity.score_toxicity(docs_of([(1, "a"), (2, None)]), model, ["doc_id"]).select("score").distinct().first()[0] == 0.0


def test_noisy_or_gradient():
    """The bias alone must reach the share of toxic documents of one sentence each."""
    texts = ["x"] * 100
    labels = np.array([1] * 20 + [0] * 80)
    model = toxicity.fit_noisy_or(texts, labels, np.full(100, 0.01), toxicity.ToxicityParams(steps=2000))
    assert 1 / (1 + math.exp(-model.bias)) == pytest.approx(0.2, abs=0.01)


VOCABULARY = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations():
    lattice = language.PieceLattice(VOCABULARY)
    logs = np.log(np.array([[0.1, 0.2], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1], [0.2, 0.1], [0.1, 0.2], [0.1, 0.1], [1e-8, 1e-8]]))
    words = ["▁abab", "▁", "▁bbaab", "▁" + "ab" * 30]
    got = language.word_scores(lattice, words, logs)
    for word, scores in zip(words[:3], got, strict=False):
        for l in range(2):
            p = math.fsum(math.prod(math.exp(logs[VOCABULARY.index(x), l]) for x in s) for s in segmentations(word, VOCABULARY))
            assert scores[l] == pytest.approx(math.log(p))
    assert got[3] == pytest.approx(language.forward(lattice.arcs(words[3]), len(words[3]), logs))
    fitted = language.fit_unigrams(lattice, len(VOCABULARY), {"▁ab": 5, "▁b": 2}, 5)
    assert np.exp(fitted[:-1]).sum() == pytest.approx(1)


def test_long_words_are_learned_from():
    """The expected pieces of a long word are those of plain sums, and a word of any length counts."""
    lattice = language.PieceLattice(VOCABULARY)
    short, long = [0.01] * (len(VOCABULARY) + 1), [0.01] * (len(VOCABULARY) + 1)
    probs = [0.1, 0.2, 0.2, 0.1, 0.2, 0.1, 0.1, 1e-8]
    word = "▁abcbaab"
    found = list(segmentations(word, [*VOCABULARY, "c"]))
    weight = [math.prod(probs[VOCABULARY.index(x) if x in VOCABULARY else -1] for x in s) for s in found]
    for s, w in zip(found, weight, strict=True):
        for x in s:
            short[VOCABULARY.index(x) if x in VOCABULARY else -1] += 3 * w / sum(weight)
    language.add_long(long, lattice.arcs(word), len(word), 3, [math.log(p) for p in probs])
    assert long == pytest.approx(short)
    fitted = np.exp(language.fit_unigrams(lattice, len(VOCABULARY), {"▁" + "ab" * 2000: 1, "▁" + "c" * 4000: 1}, 4)[:-1])
    assert fitted.sum() == pytest.approx(1)
    assert fitted[VOCABULARY.index("ab")] > 0.4  # 1 / 7 if nothing is learned


def test_scripts_without_spaces(spark, rng):
    """Chinese and Japanese sentences are single words, told apart by what was learned from them."""
    letters = {"ja": "日本国会人年大学生時間行東京", "zh": "日本国会人年大学生时间这们来"}
    weights = {"ja": [9] * 4 + [1] * 10, "zh": [1] * 4 + [9] * 10}
    rows = [(i, "".join(rng.choices(letters[lang][:10], weights[lang][:10], k=50)), lang) for i in range(60) for lang in letters]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = language.predict_language(docs.where("doc_id >= 40"), language.fit_languages(docs.where("doc_id < 40")), ["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in out) and len(out) == 40


def test_language(spark, rng):
    kinds = {"en": "the house was very large and they went there with him".split(), "de": "das haus war sehr groß und sie gingen mit ihm dorthin".split()}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(12)), lang) for i in range(120) for lang in ("en", "de")]
    schema = "doc_id bigint, text string, lang string"
    model = language.fit_languages(spark.createDataFrame([r for r in rows if r[0] % 4], schema))
    assert model.languages == ("de", "en")
    odd = [(500, None, "en"), (501, "", None), (502, "123 !? 456", "de"), (503, "x" * 5000, None), (504, rows[0][1], None)]
    docs = spark.createDataFrame([r for r in rows if r[0] % 4 == 0] + odd, schema).withColumn("score", F.lit("clash"))
    out = language.predict_language(docs, model, ["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in out if r["doc_id"] < 500)
    by_id = {r["doc_id"]: r for r in out}
    assert [by_id[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert by_id[502]["score"] == 0.0
    assert by_id[503]["lang_pred"] in ("de", "en")
    assert by_id[504]["lang_pred"] == "en"
    nothing = language.fit_languages(spark.createDataFrame([(1, None, "en"), (2, "a", None)], schema))
    assert language.predict_language(docs, nothing, ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert language.predict_language(docs.limit(0), model, ["doc_id"]).count() == 0


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id bigint").select("doc_id", language.in_fold(F.col("doc_id"), 7, 2).alias("f")).collect()
    assert all(r["f"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)


def test_licenses(docs_of):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    texts = [
        "Licensed under the Apache License, Version 2.0.", "nothing here", None, "", "cc by cc by, CC-BY!", "MIT  License mit\nlicense",
        "gnu general public licenses", "the GNU General (Public) License v3 x" * 3, "Copyright (c) 2020 by A B C. All rights reserved.", "ccé by", "licensed under cc by-nc 4.0",
        "word " * 3000 + "mit license",
    ]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(list(enumerate(texts))), ["doc_id"]).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        words = licenses.WORD.findall((text or "").encode().lower().decode())
        places = sorted((s, label) for label, p in phrases.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split())
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert base <= set(r["labels"].split(",")) | {""}
        assert (r["score"] > 0) == bool(r["labels"])
    assert "apache-2.0" in out[0]["labels"].split(",")
    assert out[8]["labels"] == "all-rights-reserved"
    assert "cc-by-nc-4.0" in out[10]["labels"].split(",")
    assert licenses.scan_licenses(docs_of([]), ["doc_id", "labels"]).count() == 0


def test_template_markup():
    automaton = licenses.TemplateAutomaton((licenses.Template("x", "a [[b [[c]]]] {{2}} d"),))
    matches = lambda text: automaton.matches(text.split())
    assert matches("a d") == matches("a d e") == [(0, 0, 2)]
    assert [m[1:] for m in matches("z a b c q q d")] == [(1, 7)]
    assert matches("a b c q q q d") == [] and matches("a") == []
    with pytest.raises(ValueError, match="begin with a word"):
        licenses.TemplateAutomaton((licenses.Template("x", "{{1}} a"),))


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def flat(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(text.split()))


def test_regions_of_a_long_text_in_pieces(rng, make_text, monkeypatch):
    items = [(i, make_text(rng, 12)) for i in range(6)] + [(9, "a b c")]
    index = decontaminate.Benchmark(items, decontaminate.LeakParams())
    words = make_text(rng, 2000).split()
    for at in range(50, 2000, 130):
        words[at:at] = items[at % 7][1].split()
    points, _ = decontaminate.code_points([" ".join(words)])
    whole = index.regions(points)
    monkeypatch.setattr(decontaminate, "CHUNK", 300)
    assert sorted(index.regions(points)) == sorted(whole) and len({i for i, _ in whole}) == 7


def test_leaks(spark, docs_of, rng, make_text):
    params = decontaminate.LeakParams(block_chars=400)
    items = [(i, make_text(rng, rng.randrange(10, 25))) for i in range(12)] + [(50, "tiny"), (51, "exactly this é"), (52, None), (None, "x" * 40), (53, "日本語"), (54, "ab"), (55, "q = 7x"), (55, "tin")]
    rows = []
    for i in range(90):
        _, item = items[i % 14]
        letters = list(item)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(letters))
            letters[at] = rng.choice(("", "q", "qq", letters[at].upper()))
        rows.append((i, make_text(rng, rng.randrange(10)) + " " + "".join(letters).replace(" ", rng.choice((" ", "\n "))) + " " + make_text(rng, rng.randrange(10))))
    rows += [(100, None), (101, ""), (102, items[0][1]), (103, (items[0][1] + " ") * 3), (3, rows[3][1])]
    rows += [(104, "と日本語で"), (105, "if Q =\n 7X then"), (106, "ab"), (107, "日本 語"), (108, "tin")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, leaks int")
    out = decontaminate.find_leaks(docs_of(rows), benchmark, ["doc_id"], params).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        want = {}
        for i, item in items:
            if i is not None and item is not None and len(flat(item)) >= params.shortest:
                edits = least_edits(flat(item), flat(texts[r["doc_id"]] or ""))
                if edits <= decontaminate.budget(len(flat(item)), params):
                    want[i] = min(edits, want.get(i, edits))
        assert {x["item_id"]: x["edits"] for x in r["leaks"]} == want
    assert decontaminate.find_leaks(docs_of([]), benchmark, ["doc_id"]).count() == 0
    # With many blocks, what each has found is written before the next index is made: no search is left in the plan.
    plan = decontaminate.find_leaks(docs_of(rows), benchmark, ["doc_id"], params)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    one = decontaminate.find_leaks(docs_of(rows), benchmark, ["doc_id"])
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert Counter(map(str, one.collect())) == Counter(map(str, out))
    none = decontaminate.find_leaks(docs_of(rows[:3]), benchmark.limit(0), ["doc_id", "text"]).collect()
    assert [r["leaks"] for r in none] == [[], [], []]


def test_lm_scores(docs_of, rng, make_text):
    rows = [(i, make_text(rng, rng.randrange(30)).title() if i % 9 else None) for i in range(150)] + [(7, "the of the of"), (8, "the of and to")]
    rows += [(1000 + i, "x the of and " + make_text(rng, 3)) for i in range(20)]
    params = backoff_lm.LMParams(word_share=0.01, gram_share=0.0015, block_chars=500, shard_entries=20)
    out = backoff_lm.score_texts(docs_of(rows), F.col("doc_id") % 7 != 2, params).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    train = [tokens(t) for i, t in rows if i % 7 != 2]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    model = slow_model(train, count, n, v, params)
    expected = Counter()
    for i, t in rows:
        base = math.fsum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))
        expected[i, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(base, 6), round(slow_score(model, tokens(t)), 6)] += 1
    assert Counter((r[0], r[1], r[2], r[3], round(r[4], 6), round(r[5], 6)) for r in out) == expected
    assert any(len(g) == 3 for g in model[0])
    assert backoff_lm.score_texts(docs_of([]), F.lit(True)).count() == 0
    lone = backoff_lm.score_texts(docs_of([(1, "a b")]), F.lit(False)).first()
    assert (lone["n_tokens"], lone["n_known"], lone["train_tokens"], lone["base_score"], lone["score"]) == (3, 0, 0, 0.0, 0.0)


def test_lm_keeps_rare_grams_of_a_larger_corpus(docs_of, rng, make_text):
    """N-grams are kept from a fixed count on, however many tokens there are."""
    rows = [(i, make_text(rng, 150)) for i in range(1700)]
    rows += [(5000 + i, "seldom seen words here") for i in range(2)] + [(6000, "seldom seen words here")]
    out = {r["doc_id"]: r for r in backoff_lm.score_texts(docs_of(rows), F.col("doc_id") < 6000, backoff_lm.LMParams(block_chars=300_000, shard_entries=30_000)).collect()}
    train = [[*t.split(), None] for i, t in rows if i < 6000]
    count = Counter(w for t in train for w in t)
    assert sum(count.values()) > 250_000
    grams = Counter(tuple(line[i : i + size]) for line in (["^", *t] for t in train) for size in (2, 3) for i in range(len(line) - size + 1))
    assert grams["seldom", "seen", "words"] == 2
    kept = sum(c >= 2 for c in grams.values())
    assert kept > 10_000
    n, v, want = sum(count.values()), len(count), 0.0
    line = ["^", *rows[-1][1].split(), None]
    for i in range(1, len(line)):
        gram = tuple(line[max(0, i - 2) : i + 1])
        before = 1700 + 2 if gram[:-1] == ("^",) else (grams[gram[:-1]] if len(gram) == 3 else count[gram[0]])
        want += math.log10((grams[gram] - 0.75) / before)
    assert out[6000]["score"] == pytest.approx(want)
    assert out[6000]["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in line[1:]))


def slow_model(train, count, n, v, params):
    """(probabilities of kept n-grams, backoff weights, unigram probability) by plain counting; "^" begins a text."""
    heavy = {w for w, c in count.items() if c >= max(1, math.ceil(params.word_share * n))}
    seen = Counter()
    for text in train:
        line = ["^", *text]
        for size in (2, 3):
            seen.update(tuple(line[i : i + size]) for i in range(len(line) - size + 1) if all(w in heavy or w == "^" for w in line[i : i + size]))
    kept = {g: c for g, c in seen.items() if c >= max(2, math.ceil(params.gram_share * n))}
    before = {("^",): len(train), **{(w,): c for w, c in count.items()}, **kept}
    unigram = lambda w: (count[w] + 1) / (n + v + 1)
    p = {g: (c - params.discount) / before[g[:-1]] for g, c in kept.items()}
    shorter = lambda g: p[g[1:]] if len(g) > 2 else unigram(g[-1])
    backoff = {}
    for h in {g[:-1] for g in kept}:
        own = [g for g in kept if g[:-1] == h]
        backoff[h] = max(1 - math.fsum(p[g] for g in own), 1e-12) / max(1 - math.fsum(shorter(g) for g in own), 1e-12)
    return p, backoff, unigram


def slow_score(model, tokens):
    """The usual recursion of a backoff model, history by history."""
    p, backoff, unigram = model

    def chance(history, word):
        if not history:
            return unigram(word)
        if (*history, word) in p:
            return p[*history, word]
        return backoff.get(history, 1.0) * chance(history[1:], word)

    line = ["^", *tokens]
    return math.fsum(math.log10(chance(tuple(line[max(0, i - 2) : i]), line[i])) for i in range(1, len(line)))


def test_lm_texts_move_once(docs_of, rng, make_text, monkeypatch):
    """Blocks are packed when they are made; the waves and the scores move packed blocks, and keys take few bytes."""
    taken, pack = [], backoff_lm.materialise
    monkeypatch.setattr(backoff_lm, "materialise", lambda df, label: taken.append((label, df.schema.simpleString())) or pack(df, label))
    out = backoff_lm.score_texts(docs_of([(i, make_text(rng, 40)) for i in range(60)]), F.lit(True), backoff_lm.LMParams(block_chars=500, shard_entries=20))
    assert [label for label, _ in taken] == ["lm-blocks", "word-counts", "arc-weights", "arc-weights"]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "text#" not in plan and out.count() == 60


def test_lm_packing():
    draw = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = np.unique(draw.integers(0, 2**64, n, np.uint64))
        packed = backoff_lm.pack_keys(keys)
        assert (backoff_lm.unpack_keys(packed) == keys).all() and len(backoff_lm.unpack_keys(packed)) == n
        assert n < 5000 or len(packed) < 7 * n
    for values in (np.zeros(0), np.arange(900) * 0.25, draw.random(50) * 9, np.array([0.0, -0.0, 2.0**60, 1e-300])):
        back = backoff_lm.unpack_floats(backoff_lm.pack_floats(values))
        assert back.tobytes() == values.tobytes()
    assert len(backoff_lm.pack_floats(np.arange(900) * 0.25)) < 2100
