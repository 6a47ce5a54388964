"""The pipeline's stages on a small corpus with planted cases, and the query contract."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from test_duplicates import brute_classes, brute_removal
from test_models import flat, least_edits

from millrace.llm import decontaminate, mixing, near_dedup, queries, substrings


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, rng, make_text, tmp_path_factory):
    """A folder with documents (copies, near copies, passages, leaks, junk, nulls) and benchmark."""
    items = [(i, make_text(rng, 30)) for i in range(3)]
    passage = make_text(rng, 30)
    rows = []
    for i in range(60):
        words = make_text(rng, rng.randrange(40, 80)).split()
        if i % 10 == 1:
            words = rows[-1][1].split()
        elif i % 10 == 2:
            words = rows[-1][1].split()
            words[5] = "changed"
        elif i % 10 == 4:
            words += items[i % 3][1].split()
        elif i % 10 in (5, 6):
            words = words[:20] + passage.split() + words[20:]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "12 34 !!"), (103, "word"), (0, rows[0][1])]
    path = str(tmp_path_factory.mktemp("corpus"))
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = [(i, t, "en" if i % 7 else None, f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, kind).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, corpus, tmp_path):
    path, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert after
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "language":
            assert sorted(after) == sorted(r for r in before if r[1] and any(map(str.isalpha, r[1])))
            assert docs.where("lang IS NULL").count() == 0
        elif name == "near_duplicates":
            classes = brute_classes(before, near_dedup.NearParams())  # repeated rows count
            assert sorted(after) == sorted((i, t) for i, t in dict(before).items() if classes[i] == i)
        elif name == "repeated_passages":
            want = brute_removal(before, 20)
            assert len(after) == sum(n > gone for _, n, gone, _ in want)
            assert sum(len(t.split()) for _, t in after) == sum(n - gone for _, n, gone, _ in want)
        elif name == "benchmark_leaks":
            near = lambda t: any(least_edits(flat(x), flat(t)) <= decontaminate.budget(len(flat(x)), decontaminate.LeakParams()) for _, x in items)
            assert sorted(after) == sorted((i, t) for i, t in before if not near(t))
        else:
            assert {i for i, _ in after} <= {i for i, _ in before}
            sizes = mixing.mix(spark.createDataFrame([(i, t, "s") for i, t in before], "doc_id bigint, text string, source string"))
            total = sizes.agg(F.sum("size")).first()[0]
            assert docs.agg(F.sum("n_words")).first()[0] == pytest.approx(1.5 * total, abs=5)


def test_mixture_keeps_documents_that_share_an_id(spark, rng, make_text):
    """Documents without an id, or with that of another, get their own takes, and sources reach their targets."""
    rows = [(None if i % 3 == 0 else i // 2 if i % 3 == 1 else i, make_text(rng, rng.randrange(20, 60)), "en", f"s{i % 2}", 1) for i in range(90)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, "en", "s0", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    plan = mixing.mix(docs).collect()
    assert Counter((r["source"], r["doc_id"], r["n_words"]) for r in out) == Counter((r["source"], r["doc_id"], t["n_words"]) for r in plan for t in r["takes"])
    for source in ("s0", "s1"):
        target = next(r["target"] for r in plan if r["source"] == source)
        assert sum(r["n_words"] for r in out if r["source"] == source) == int(target)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    assert all(any(t.startswith(r["text"]) for t in texts[r["doc_id"]]) for r in out)
    whole = Counter((r["doc_id"], r["text"], r["pass"]) for r in out)
    assert max(whole[r[0], r[1], n] for r in rows[1:] for n in range(2)) == 1 and any(i is None for i, _, _ in whole)
    again = corpus_pipeline.mix_sources(spark, docs.repartition(4), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_near_duplicates_of_texts_that_share_an_id(spark, rng, make_text):
    """Different texts of one id, or without one, are documents of their own; of each class one row stays."""
    texts = [make_text(rng, 40) for _ in range(12)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in texts]
    ids = [3, 3, 3, None, None, 5, 6, 7, 8, None, 1, 1]
    rows = [*zip(ids, texts), (2, near[0]), (None, near[1]), (3, near[3]), (9, texts[5]), (6, texts[6]), (None, texts[9]), (4, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    classes = brute_classes([(n, t) for n, (_, t) in enumerate(rows)], near_dedup.NearParams())
    members = {}
    for n, c in classes.items():
        members.setdefault(c, []).append(rows[n])
    want = Counter(min((i is None, i or 0) for i, _ in group) for group in members.values())
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got = out.collect()
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == want and len(got) == len(members)
    assert {r["text"] for r in got} >= set(texts) - {texts[0], texts[3]} | {near[0], near[3]} - {None}
    assert sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), "").collect())) == sorted(map(str, got))


def test_columns_with_the_names_of_inner_ones_are_kept(spark, rng, make_text):
    shared = make_text(rng, 25)
    rows = [(i, make_text(rng, 30) + " " + shared, "s", 9, *[f"KEEP{i}-{n}" for n in range(12)]) for i in range(6)]
    names = ["_row", "_mark", "_taken", "_take", "_position", "_id", "_own", "_runs", "_place_id", "_place_mark", "_text", "_kept_0"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    for out in (mixing.mixed_documents(docs), substrings.without_repeats(docs), substrings.without_repeats(docs.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("n_chars", F.col("n_chars")))):
        got = out.collect()
        assert out.columns[:16] == docs.columns and got
        assert all(all(r[n] == f"KEEP{r['_row'].split('-')[0][4:]}-{k}" for k, n in enumerate(names)) for r in got)
    benchmark = spark.createDataFrame([(1, shared)], "item_id bigint, text string")
    leaks = decontaminate.find_leaks(docs, benchmark, names).collect()
    assert len(leaks) == 6 and all(r["_text"] == f"KEEP{r['_row'][4:].split('-')[0]}-10" and len(r["leaks"]) == 1 for r in leaks)


def test_run_equals_stages(spark, corpus):
    path, _ = corpus
    first = corpus_pipeline.run(spark, path)
    again = corpus_pipeline.run(spark, path)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_empty_corpus(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the standard tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries.queries()[name](spark, SF)
    result = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in sorted(columns)) for r in frame.collect()) == Counter(tuple(r[columns.index(c)] for c in sorted(columns)) for r in result.fetchall())


def test_queries_are_registered():
    known = contract.queries()
    assert set(queries.queries()) <= set(known) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(contract.oracle_sql())
