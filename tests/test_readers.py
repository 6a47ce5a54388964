import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators.cutoffs import limit_rows
from millrace.sources.paths import resolve_paths
from millrace.sources.readers import parse_objects, read_documents, read_lines, read_rows, read_rows_after, read_table, string_field
from millrace.sources.registry import SOURCES, source


def texts(df):
    return [r.text for r in df.orderBy("ord").collect()]


def test_paths_keep_argument_order_and_duplicates(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / name).write_text(name)
    missing = str(tmp_path / "none*.x")
    got = resolve_paths(spark, [str(tmp_path / "c.md"), str(tmp_path / "*.txt"), str(tmp_path / "a.txt"), missing])
    assert [p.rsplit("/", 1)[1] for p in got] == ["c.md", "a.txt", "b.txt", "a.txt", "none*.x"]
    assert got[-1] == missing


def test_whole_files(spark, tmp_path):
    (tmp_path / "1.txt").write_bytes(b"a\r\nb\rc")
    (tmp_path / "2.txt").write_text("  ")
    (tmp_path / "3.txt").write_text("")
    df = read_documents(spark, "text", [str(tmp_path / "2.txt"), str(tmp_path / "1.txt"), str(tmp_path / "2.txt"), str(tmp_path / "3.txt")])
    # Spark reads no row from an empty file, which would have no tokens either.
    assert texts(df) == ["  ", "a\nb\nc", "  "]


def test_json_lines(spark, tmp_path):
    lines = [
        '{"text": "one"}', "", '{"text": 12}', '{"text": null}', '{"text": ["a"]}', '{"text": " \\u3000 "}',
        "　\x1c", '{"text": "\\u3000x\\u001c"}', '{"text": "first", "text": "last"}', '{"other": 1}', '  {"text": "two"}',
    ]
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    assert texts(read_documents(spark, "jsonl", str(path))) == ["one", "　x\x1c", "last", "two"]


@pytest.mark.parametrize("bad", ['{"text": ', '["text"]', "7"])
def test_malformed_lines_fail(spark, tmp_path, bad):
    (tmp_path / "rows.jsonl").write_text('{"text": "a"}\n' + bad + "\n")
    with pytest.raises(Exception):
        read_documents(spark, "jsonl", str(tmp_path / "rows.jsonl")).collect()


def test_line_order_across_splits_and_files(spark, tmp_path):
    for name, count in (("z.jsonl", 700), ("a.jsonl", 400)):
        (tmp_path / name).write_text("".join(json.dumps({"text": f"{name}-{i}"}) + "\n" for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_documents(spark, "jsonl", [str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl"), str(tmp_path / "z.jsonl")])
        assert df.rdd.getNumPartitions() > 4
        once = [f"z.jsonl-{i}" for i in range(700)]
        assert texts(df) == once + [f"a.jsonl-{i}" for i in range(400)] + once
        assert df.select("ord").distinct().count() == 1800
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parquet_order_and_types(spark, tmp_path):
    spark.range(50).select(F.col("id").cast("string").alias("text"), F.col("id").alias("n")).coalesce(1).write.parquet(str(tmp_path / "p"))
    files = str(tmp_path / "p")
    assert texts(read_documents(spark, "parquet", files)) == [str(i) for i in range(50)]
    assert texts(read_documents(spark, "parquet", [files, files])) == [str(i) for i in range(50)] * 2
    assert texts(read_documents(spark, "parquet", files, text_column="n")) == []
    assert texts(read_documents(spark, "parquet", files, text_column="absent")) == []


def test_scans_are_pruned(spark, tmp_path):
    spark.range(5).select("id", F.lit("x").alias("text"), F.lit("y").alias("wide")).write.parquet(str(tmp_path / "p"))
    plan = read_documents(spark, "parquet", str(tmp_path / "p"))._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan and "id" not in plan.split("ReadSchema")[1].split(">")[0].replace("row_index", "")
    rows = read_rows(spark, str(tmp_path / "p"), ["text"])
    assert rows.columns == ["text", "ord"]


def test_tables_with_a_split(spark):
    spark.range(20).select(F.when(F.col("id") < 15, "train").otherwise("test").alias("split"), F.col("id").cast("string").alias("text")).coalesce(1).write.mode("overwrite").saveAsTable("corpus_rows")
    try:
        assert texts(read_documents(spark, "table", table="corpus_rows")) == [str(i) for i in range(15)]
        assert texts(read_documents(spark, "table", table="corpus_rows", split="test")) == [str(i) for i in range(15, 20)]
        assert read_table(spark, "corpus_rows", split=None).count() == 20
    finally:
        spark.sql("DROP TABLE corpus_rows")


@pytest.mark.parametrize("kind,kwargs", [("csv", {"paths": "x"}), ("jsonl", {}), ("text", {"paths": []}), ("table", {})])
def test_bad_sources_raise_before_a_job(spark, kind, kwargs):
    with pytest.raises(ValueError):
        read_documents(spark, kind, **kwargs)


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(Exception):
        read_documents(spark, "parquet", str(tmp_path / "none.parquet")).count()


def test_field_names_are_quoted(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a b.c": "x"}\n')
    rows = parse_objects(read_lines(spark, str(tmp_path / "r.jsonl")))
    assert rows.select(string_field(F.col("row"), "a b.c")).first()[0] == "x"


def test_registry():
    assert {n: (s.kind, len(s.files), s.text_column) for n, s in SOURCES.items()} == {
        "ultrafineweb_zh": ("parquet", 11, "content"),
        "cci4_zh": ("jsonl", 16, "text"),
        "nemotron_cc_math_4plus": ("parquet", 46, "text"),
    }
    assert source("cci4_zh").paths("s3a://bucket/")[0] == "s3a://bucket/zh_cc-high-loss0/000_00000.jsonl"
    with pytest.raises(ValueError):
        source("nothing")


def written_bytes(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_lines_are_not_copied(spark, tmp_path):
    """Reading, counting and limiting lines writes no more for a corpus ten times as large."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    grown = []
    for count in (2000, 20000):
        path = tmp_path / f"{count}.jsonl"
        path.write_text("".join(json.dumps({"text": f"a line of some length that has the number {i}"}) + "\n" for i in range(count)))
        before = written_bytes(shared)
        docs = read_documents(spark, "jsonl", str(path))
        assert docs.count() == count
        assert texts(limit_rows(docs, 7)) == [f"a line of some length that has the number {i}" for i in range(7)]
        grown.append(written_bytes(shared) - before)
    assert max(grown) < 50_000


def test_line_places_hold_when_settings_change(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"text": str(i)}) + "\n" * (1 + i % 3) for i in range(3000)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        docs = read_documents(spark, "jsonl", str(path))
        places = {r.text: r.ord for r in docs.collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        assert {r.text: r.ord for r in docs.collect()} == places and len(set(places.values())) == 3000
        assert texts(limit_rows(docs, 1234)) == [str(i) for i in range(1234)]
        other = read_documents(spark, "jsonl", str(path))
        assert texts(other) == [str(i) for i in range(3000)] and other.rdd.getNumPartitions() != docs.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("kind", ["jsonl", "parquet", "text"])
def test_first_documents_open_leading_files_only(spark, tmp_path, kind):
    for i in range(6):
        rows = [f"{i}-{j}" for j in range(1 if kind == "text" else 10)]
        if kind == "jsonl":
            (tmp_path / f"{i}.x").write_text("".join(json.dumps({"text": t}) + "\n\n" for t in ["", *rows]))
        elif kind == "parquet":
            pq.write_table(pa.table({"text": ["", *rows]}), tmp_path / f"{i}.x")
        else:
            (tmp_path / f"{i}.x").write_text(rows[0])
    n = 2 if kind == "text" else 15
    docs = read_documents(spark, kind, str(tmp_path / "*.x"), first=n)
    whole = read_documents(spark, kind, str(tmp_path / "*.x"))
    assert texts(limit_rows(docs, n)) == texts(limit_rows(whole, n))
    assert {t.split("-")[0] for t in texts(docs)} == {"0", "1", "2"}  # one file, then two more
    (tmp_path / "5.x").write_bytes(b"not to be opened")
    assert texts(limit_rows(read_documents(spark, kind, str(tmp_path / "*.x"), first=n), n))
    assert len(texts(read_documents(spark, kind, str(tmp_path / "[0-4].x"), first=999))) == 5 * (1 if kind == "text" else 10)


def test_rows_after_skipped_groups(spark, tmp_path):
    at = 0
    for i, (rows, size) in enumerate([(25, 10), (0, 10), (7, 3), (40, 40)]):
        part = pa.table({"text": [f"t{j}" for j in range(at, at + rows)], "n": pa.array(range(at, at + rows), pa.int32())})
        pq.write_table(part if i != 2 else part.drop(["n"]), tmp_path / f"{i}.parquet", row_group_size=size)
        at += rows
    path = str(tmp_path / "*.parquet")
    whole = {r.text: (r.ord, r.n) for r in read_rows(spark, path, ["text", "n"]).collect()}
    for skip in (0, 1, 9, 10, 11, 24, 25, 26, 30, 32, 71, 72, 99):
        got = read_rows_after(spark, path, skip, ["text", "n", "none"])
        assert got.columns == ["text", "n", "none", "ord"]
        rows = got.orderBy("ord").collect()
        assert [r.text for r in rows] == [f"t{j}" for j in range(skip, 72)]
        assert all(whole[r.text] == (r.ord, r.n) and r.none is None for r in rows)
    # A skipped group's pages can be anything, as they are not read.
    first = tmp_path / "0.parquet"
    end = pq.ParquetFile(first).metadata.row_group(1).column(0).dictionary_page_offset
    first.write_bytes(b"PAR1" + b"x" * (end - 4) + first.read_bytes()[end:])
    assert [r.text for r in read_rows_after(spark, path, 12, ["text"]).orderBy("ord").collect()] == [f"t{j}" for j in range(12, 72)]
    with pytest.raises(Exception):
        read_rows_after(spark, path, 9, ["text"]).collect()
