import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators.bpe_codec import Tokenizer
from millrace.operators.chat import convert_chat
from millrace.operators.quota import CorpusSpec, TokenizerSpec
from millrace.operators.samples import mix, pick_seed, replace_section, sample_summary, skip_known, top_up
from millrace.operators.windows import MixtureSource
from millrace.plans import samples as sample_plan
from millrace.plans.corpus import read_corpus, tokenise_corpus, train_tokenizer
from millrace.plans.training import load_datasets, open_datasets, sample_set
from millrace.sinks import token_shards
from millrace.sinks.token_shards import read_binary_blocks, read_shard_metas, write_binary_shards
from millrace.sources.readers import leading_files, parse_objects, read_documents, read_lines
from millrace.sources.registry import CorpusSource
from millrace.streaming.ingest import append_to, convert_stream, encode_stream, stream_lines, stream_parquet


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rows = [f"document {i} says the same thing again and again " * (i % 4 + 1) for i in range(40)]
    (root / "docs.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in [*rows, "", "  "]))
    (root / "note.txt").write_text("the local note")
    return root, rows


@pytest.fixture(scope="module")
def coder(spark, corpus, tmp_path_factory):
    root, _ = corpus
    spec = {
        "raw_datasets": [
            {"name": "docs", "kind": "jsonl", "path": str(root / "docs.jsonl"), "weight": 3},
            {"name": "note", "kind": "local", "path": str(root / "note.txt"), "weight": 1},
        ],
        "path": str(tmp_path_factory.mktemp("out") / "tokenizer"), "vocab_size": 290, "max_documents": 20,
    }
    trained = train_tokenizer(spark, TokenizerSpec.of(spec))
    assert Tokenizer.load(spark, spec["path"]) == trained and trained.vocab_size == 290
    with pytest.raises(Exception, match="exists"):
        trained.save(spark, spec["path"])
    return trained


def test_binary_corpus(spark, corpus, coder, tmp_path):
    root, rows = corpus
    docs = read_documents(spark, "jsonl", str(root / "docs.jsonl"))
    out = str(tmp_path / "shards")
    manifest = {r.shard_id: r for r in tokenise_corpus(docs, coder, out, 200, binary=True).collect()}
    expected = [r[0] for r in docs.orderBy("ord").select(coder.encode(F.col("text"))).collect()]
    flat, offsets = [], 0
    for k in sorted(manifest):
        meta = json.loads((tmp_path / "shards" / f"{k:05d}.meta.json").read_text())
        ids = np.fromfile(tmp_path / "shards" / f"{k:05d}.tokens", "<u2")
        index = np.fromfile(tmp_path / "shards" / f"{k:05d}.index", "<u8")
        assert meta["num_tokens"] == len(ids) == manifest[k].num_tokens == index[-1]
        assert meta["num_docs"] == len(index) - 1 == manifest[k].num_docs
        assert index[0] == 0 and np.diff(index.astype(int)).tolist() == [len(d) for d in expected[offsets : offsets + len(index) - 1]]
        offsets += len(index) - 1
        flat += ids.tolist()
    assert flat == [i for d in expected for i in d]
    total = json.loads((tmp_path / "shards" / "dataset.meta.json").read_text())
    assert (total["num_shards"], total["num_docs"], total["num_tokens"]) == (len(manifest), 40, len(flat))
    with pytest.raises(FileExistsError):
        tokenise_corpus(docs, coder, out, 200)
    table = tokenise_corpus(docs, coder, out, 200, max_documents=3, overwrite=True)
    assert table.agg(F.sum("num_docs")).first()[0] == 3 and spark.read.parquet(out).count() == 3
    with pytest.raises(ValueError):
        tokenise_corpus(docs, coder, str(tmp_path / "x"), dtype="uint8")


def test_binary_blocks_feed_windows(spark, corpus, coder, tmp_path, monkeypatch):
    root, _ = corpus
    out = str(tmp_path / "shards")
    tokenise_corpus(read_documents(spark, "jsonl", str(root / "docs.jsonl")), coder, out, 300, dtype="uint32", binary=True)
    manifest, blocks = load_datasets(spark, {"docs": out}, 32, 20, labelled=False)
    kept = F.sum(F.least(F.size("ids"), F.lit(32)))
    assert blocks.agg(kept).first()[0] == manifest.agg(F.sum("num_tokens")).first()[0]
    # Reading in short spans gives the same blocks.
    monkeypatch.setattr(token_shards, "SPAN_TOKENS", 64)
    _, short = load_datasets(spark, {"docs": out}, 32, 20, labelled=False)
    assert sorted(short.collect()) == sorted(blocks.collect())
    windows = sample_set(manifest, blocks, [MixtureSource("docs")], 30, 20, 32, 1).collect()
    _, fetch = open_datasets(spark, {"docs": out})
    assert sorted(sample_set(manifest, fetch, [MixtureSource("docs")], 30, 20, 32, 1).collect()) == sorted(windows)
    assert len(windows) == 30 and all(len(r.x) == len(r.y) == 20 and r.x[1:] == r.y[:-1] for r in windows)


def test_attempts_of_one_shard_at_once(tmp_path):
    """Only the reported attempt is published, whichever ends last, and publishing can run twice at the same time."""
    root = f"file:{tmp_path}"
    (tmp_path / token_shards.STAGING).mkdir()
    for shard in range(20):
        first, second = (token_shards._ShardFiles(root, shard, "uint16", True, 9) for _ in range(2))
        for attempt, value in ((first, 1), (second, 2)):
            attempt.add(np.array([value] * 3), np.array([3]), np.array([value] * 3))
        mark, tokens, docs = first.close()
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda _: token_shards.publish_shard(root, shard, mark, True), range(4)))
        second.add(np.array([2]), np.array([1]), np.array([2]))
        second.close()  # after the other was published
        assert (tokens, docs) == (3, 1)
        assert np.fromfile(tmp_path / f"{shard:05d}.tokens", "<u2").tolist() == [1, 1, 1]
        assert np.fromfile(tmp_path / f"{shard:05d}.labels", "<i4").tolist() == [1, 1, 1]
        assert json.loads((tmp_path / f"{shard:05d}.meta.json").read_text())["num_tokens"] == 3
    with pytest.raises(OSError):
        token_shards.publish_shard(root, 99, "none", True)


def test_windows_from_a_token_table(spark, corpus, coder, tmp_path, monkeypatch):
    """A token table gives the windows that binary shards give, beside one too, and row groups no window needs are not read."""
    monkeypatch.setattr(token_shards, "GROUP_BYTES", 64)
    root, _ = corpus
    docs = read_documents(spark, "jsonl", str(root / "docs.jsonl")).repartition(3)
    flat, table = str(tmp_path / "flat"), str(tmp_path / "table")
    # Spark checks the size of a row group after a hundred rows only.
    many = docs.unionByName(docs.withColumn("ord", F.col("ord") + 10**6)).unionByName(docs.withColumn("ord", F.col("ord") + 10**7))
    many = many.crossJoin(spark.range(5)).withColumn("ord", F.col("ord") + F.col("id") * 10**8).drop("id")
    for path, binary in ((flat, True), (table, False)):
        tokenise_corpus(many, coder, path, 20_000, binary=binary)
    sources = [MixtureSource("docs")]
    whole, fetch = open_datasets(spark, {"docs": flat})
    manifest, group_fetch = open_datasets(spark, {"docs": table})
    assert sorted(manifest.select("shard_id", "num_tokens", "num_docs").collect()) == sorted(whole.select("shard_id", "num_tokens", "num_docs").collect())
    want = sorted(sample_set(whole, fetch, sources, 300, 20, 32, 1).collect())
    assert sorted(sample_set(manifest, group_fetch, sources, 300, 20, 32, 1).collect()) == want and len(want) == 300
    both, mixed = open_datasets(spark, {"a": flat, "b": table})
    windows = sample_set(both, mixed, [MixtureSource("a"), MixtureSource("b")], 60, 20, 32, 1).collect()
    assert {r.source for r in windows} == {"a", "b"} and all(r.x[1:] == r.y[:-1] for r in windows)
    groups = spark.read.parquet(f"{table}/_groups").collect()
    assert len(groups) > 2 * len({g.shard_id for g in groups})
    stored = spark.read.parquet(table).orderBy("shard_id", "ord").select("shard_id", "tok_start", F.size("ids").alias("n")).collect()
    assert all(b.tok_start == (a.tok_start + a.n if a.shard_id == b.shard_id else 0) for a, b in zip(stored, stored[1:]))
    # Overwrite the bytes of all groups but those of shard 1: its windows are read as before.
    for file in (tmp_path / "table").glob("shard_id=*/*.parquet"):
        if "shard_id=1" not in str(file):
            content = file.read_bytes()
            with open(file, "r+b") as out:
                out.write(b"x" * (len(content) - 8 - int.from_bytes(content[-8:-4], "little")))
    plan = spark.createDataFrame([(0, i, 1, 0, "docs", 1, 37 * i) for i in range(40)], "worker int, draw bigint, seed int, attempt int, source string, shard_id int, start bigint")
    at = {(r.shard_id, r.start): (r.x, r.y) for r in fetch(plan, 20, "ids").collect()}
    assert {(r.shard_id, r.start): (r.x, r.y) for r in group_fetch(plan, 20, "ids").collect()} == at


def test_labelled_windows_from_a_token_table(spark, tmp_path):
    rows = [(i, list(range(7 * i, 7 * i + 7)), [-100] * 3 + list(range(7 * i + 3, 7 * i + 7))) for i in range(30)]
    tokens = spark.createDataFrame(rows, "ord bigint, ids array<int>, labels array<int>").withColumn("shard_id", F.lit(0))
    token_shards.write_token_table(tokens.repartition(4), str(tmp_path / "t"))
    token_shards.write_table_meta(spark, str(tmp_path / "t"), spark.sql("SELECT 0 AS shard_id, 210L AS num_tokens, 30L AS num_docs"), "uint16", 300)
    manifest, fetch = open_datasets(spark, {"s": str(tmp_path / "t")})
    found = sample_set(manifest, fetch, [MixtureSource("s")], 50, 9, 32, 3, mode="sft").collect()
    assert len(found) == 50
    for r in found:
        assert r.x == list(range(r.start, r.start + 9)) and r.y == [v if v % 7 >= 3 else -100 for v in range(r.start + 1, r.start + 10)]
    beyond = spark.createDataFrame([(0, 0, 1, 0, "s", 0, 205)], "worker int, draw bigint, seed int, attempt int, source string, shard_id int, start bigint")
    with pytest.raises(Exception, match="ends before token"):
        fetch(beyond, 9, "ids").collect()


def test_reader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_shard_metas(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "dataset.meta.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        read_shard_metas(spark, str(tmp_path / "empty"))
    bad = tmp_path / "bad"
    bad.mkdir()
    meta = {"dtype": "uint16", "num_tokens": 3, "num_docs": 1}
    (bad / "00000.meta.json").write_text(json.dumps({**meta, "dtype": "float"}))
    with pytest.raises(ValueError, match="float"):
        read_shard_metas(spark, str(bad))
    (bad / "00000.meta.json").write_text(json.dumps(meta))
    row = read_shard_metas(spark, str(bad)).first()
    assert row.tokens.endswith("/00000.tokens") and row.labels.endswith("/00000.labels") and row.label_dtype == "int32"
    np.arange(3, dtype="<u2").tofile(bad / "00000.tokens")
    assert read_binary_blocks(read_shard_metas(spark, str(bad)), "s", 2).orderBy("block_id").first().ids == [0, 1]
    np.arange(2, dtype="<u2").tofile(bad / "00000.tokens")
    with pytest.raises(Exception, match="does not hold 3 tokens"):
        read_binary_blocks(read_shard_metas(spark, str(bad)), "s", 2).collect()


def test_labels_and_empty_shards(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, [1, 2], [-100, 2]), (0, 7, [3], [-100]), (1, 9, [4], [4])], "shard_id int, ord bigint, ids array<int>, labels array<int>")
    manifest = spark.createDataFrame([(0, 3), (1, 1)], "shard_id int, num_tokens bigint")
    write_binary_shards(rows, manifest, str(tmp_path / "l"), "uint16", 10)
    blocks = read_binary_blocks(read_shard_metas(spark, str(tmp_path / "l")), "s", 8, labelled=True).orderBy("shard_id").collect()
    assert [(r.ids, r.labels) for r in blocks] == [([1, 2, 3], [-100, 2, -100]), ([4], [4])]
    assert json.loads((tmp_path / "l" / "dataset.meta.json").read_text())["supervised_tokens"] == 2
    write_binary_shards(rows.where("ord < 0"), manifest.limit(0), str(tmp_path / "e"), "uint16", 10)
    assert read_shard_metas(spark, str(tmp_path / "e")).select("num_tokens", "num_docs").collect() == [(0, 0)]


def test_streams_take_up_where_they_stopped(spark, coder, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put = lambda a, b: spark.range(a, b).select(F.col("id"), F.when(F.col("id") == 3, "  ").otherwise(F.concat(F.lit("text "), "id")).alias("text")).write.mode("append").parquet(folder)
    for a, b, seen in ((0, 5, 4), (5, 9, 8), (9, 9, 8)):
        put(a, b)
        append_to(encode_stream(stream_parquet(spark, folder, "id bigint, text string"), coder, "id"), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == spark.read.parquet(out).select("id").distinct().count() == seen


def test_a_stream_of_chats_equals_the_batch(spark, tmp_path):
    """Also when a batch ended but was not noted as done, and is run again."""
    folder, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    folder.mkdir()

    def put(name, rows):
        chats = [{"messages": [{"role": "user", "content": f"{name} {i}"}, {"role": "assistant", "content": "yes"}][: 2 - (i % 5 == 4)]} for i in range(rows)]
        (folder / name).write_text("".join(json.dumps(c) + "\n" * (1 + i % 2) for i, c in enumerate(chats)))

    run = lambda: convert_stream(stream_lines(spark, str(folder), 1), str(out), str(mark), "chats").awaitTermination()
    stored = lambda: sorted(json.loads(x)["text"] for p in out.glob("batch-*/*.txt") for x in p.read_text().splitlines())
    batch = lambda: sorted(r.text for r in convert_chat(parse_objects(read_lines(spark, str(folder))), "chats").where("text IS NOT NULL").collect())
    put("a.jsonl", 30)
    put("b.jsonl", 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        run()
        assert stored() == batch() and len(stored()) == 24 + 6
        put("c.jsonl", 12)
        run()
        commits = sorted((mark / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        assert len(commits) == 3 and stored() == batch()
        commits[-1].unlink()
        (mark / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
        run()
        assert stored() == batch() and len(list(out.glob("batch-*"))) == 3
        lines = [json.loads(x)["text"] for p in sorted(out.glob("batch-000000000/*.txt")) for x in p.read_text().splitlines()]
        assert [t.split("\n")[1].split()[1] for t in lines] == [f"{i}<|im_end|>" for i in range(30) if i % 5 != 4]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _json_source(root, name, monkeypatch, known=None):
    files = []
    for f in range(3):
        rows = [{"text": f"{name}-{f}-{i}" if i % 3 else " ", "source": "" if i % 2 else "web", "metadata": {"source": "meta"}} for i in range(12)]
        (root / f"{f}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        files.append(f"{f}.jsonl")
    monkeypatch.setitem(sample_plan.source.__globals__["SOURCES"], name, CorpusSource(name, "jsonl", files, "text", known_counts=known or {}))
    return [f"{name}-{f}-{i}" for f in range(3) for i in range(12) if i % 3]


def _lines(spark, path):
    return [json.loads(r.line) for r in sample_plan.read_lines(spark, path).orderBy("ord").collect()]


@pytest.mark.parametrize("known", [None, {"0.jsonl": 8}])
def test_samples_grow_without_gaps_or_repeats(spark, tmp_path, monkeypatch, known):
    (tmp_path / "src").mkdir()
    root = str(tmp_path / "out")
    valid = _json_source(tmp_path / "src", "web", monkeypatch, known)
    other = _json_source(tmp_path / "src", "web_more", monkeypatch)
    for target in (5, 10, 10, 21, 1000):
        path, rows = sample_plan.extend_sample(spark, root, "web", target, str(tmp_path / "src"))
        expected = [t.replace("web_more", "web") for t in other][:target]
        got = _lines(spark, path)
        assert rows == len(got) == min(target, len(valid))
        assert [r["text"].replace("web_more", "web") for r in got] == expected
        assert {r["dataset"] for r in got} == {"web"} and set(got[0]) == {"text", "dataset", "source", "metadata"}
        assert {r["source"] for r in got} <= {"web", "meta"}
    # A longer name with the same beginning is another source.
    path, rows = sample_plan.extend_sample(spark, root, "web_more", 7, str(tmp_path / "src"))
    assert rows == 7 and {r["dataset"] for r in _lines(spark, path)} == {"web_more"}


def test_parquet_samples_go_on_behind_their_last_row(spark, tmp_path, monkeypatch):
    """A noted position spares reading what comes before: the files passed can even be gone."""
    (tmp_path / "src").mkdir()
    files, valid = [], []
    for f in range(4):
        texts = [f"{f}-{i}" if i % 4 else " " for i in range(40)]
        valid += [t for t in texts if t.strip()]
        pq.write_table(pa.table({"text": texts, "source": ["web"] * 40}), tmp_path / "src" / f"{f}.parquet", row_group_size=10)
        files.append(f"{f}.parquet")
    monkeypatch.setitem(sample_plan.source.__globals__["SOURCES"], "tab", CorpusSource("tab", "parquet", files, "text", extra_columns=["source"]))
    root, src = str(tmp_path / "out"), tmp_path / "src"
    for target in (7, 20, 65, 70, 1000):
        path, rows = sample_plan.extend_sample(spark, root, "tab", target, str(src))
        assert [r["text"] for r in _lines(spark, path)] == valid[:target] and rows == min(target, len(valid))
        if target == 70:  # the 70th valid row is in the third file, behind its first row group
            for name in ("0.parquet", "1.parquet"):
                (src / name).write_bytes(b"gone")
            content = (src / "2.parquet").read_bytes()
            second = pq.ParquetFile(src / "2.parquet").metadata.row_group(0).total_byte_size
            (src / "2.parquet").write_bytes(b"PAR1" + b"x" * (second // 2) + content[4 + second // 2:])


def test_mix_and_summary(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    root = str(tmp_path / "out")
    _json_source(tmp_path / "src", "one", monkeypatch)
    spark.createDataFrame([("chat", "x", "p", 1, None)], sample_plan.SUMMARY_SCHEMA).write.json(f"{root}/sample_summary")
    for target in (4, 6):
        summary = sample_plan.extend_samples(spark, root, ["one", "one"], target, str(tmp_path / "src"))
        rows = {(r.section, r.name, r.rows, r.target) for r in summary.collect()}
        assert rows == {("chat", "x", 1, None), ("pretrain", "one", target, target), ("pretrain", "mixed_pretrain", 2 * target, None)}
        assert summary.count() == 3
    texts = [r["text"] for r in _lines(spark, f"{root}/pretrain/mixed_pretrain_sample")]
    assert len(texts) == 12 and texts[:6] == texts[6:]
    with pytest.raises(ValueError):
        sample_plan.extend_samples(spark, root, ["absent"], 1, "x")


def test_small_sample_operators(spark):
    sizes = {"a": 3, "b": 0, "c": 5, "d": 9, "e": 1}
    total = lambda some: sum(sizes[p] for p in some)
    assert [leading_files(list("abcde"), n, total) for n in (0, 3, 4, 9, 99)] == [[], ["a"], list("abc"), list("abcde"), list("abcde")]
    assert skip_known(["r/a", "r/b", "r/c"], {"a": 10, "c": 1}, 12) == (["r/b"], 1)
    assert skip_known(["r/a"], {"a": 10}, 9) == (["r/a"], 9)
    sizes = spark.createDataFrame([("n", "p1", 5), ("n", "p2", 9), ("n", "p3", 9), ("n", "p4", 12), ("m", "q", 0)], "name string, path string, rows bigint")
    assert pick_seed(sizes, 12).collect() == [("n", "p2", 9)]
    available = spark.range(20).select(F.col("id").alias("ord"), F.lit("a").alias("dataset"))
    existing = spark.createDataFrame([(100 + i, "a") for i in range(3)], "ord bigint, dataset string")
    assert sorted(r.ord for r in top_up(available, existing, 5).collect()) == [3, 4, 100, 101, 102]
    assert top_up(available, existing, 2).count() == 3
    totals = {r.name: (r.rows, r.target) for r in sample_summary(existing, 5).collect()}
    assert totals == {"a": (3, 5), "mixed_pretrain": (3, None)}
    with pytest.raises(ValueError):
        mix([])
    old = spark.createDataFrame([("s", 1), ("t", 2)], "section string, v int")
    new = spark.createDataFrame([(9,)], "v int")
    assert sorted(replace_section(old, "s", new).collect()) == [("s", 9), ("t", 2)]


def test_training_reads_leading_files_only(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in ("", f"{i}a", f"{i}b")))
    (tmp_path / "9.jsonl").write_text("not json\n")
    corpus = CorpusSpec("c", "jsonl", path=str(tmp_path / "*.jsonl"))
    assert [r.text for r in read_corpus(spark, corpus, 5).orderBy("ord").collect()][:5] == ["0a", "0b", "1a", "1b", "2a"]
