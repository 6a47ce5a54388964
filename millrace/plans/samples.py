"""Extend per-source samples to a target and rebuild their mix."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import count_label
from millrace.operators.cutoffs import cuts, ord_bucket
from millrace.operators.samples import (
    mix,
    normalise_columns,
    normalise_json,
    pick_seed,
    replace_section,
    skip_known,
)
from millrace.session import materialise
from millrace.sinks.outputs import write_sample_jsonl
from millrace.sources.paths import children, delete, exists, read_file, resolve_paths, write_file
from millrace.sources.readers import FILE_SHIFT, leading_files, parse_objects, read_lines, read_rows, read_rows_after, read_table
from millrace.sources.registry import CorpusSource, source

POSITION = "_position.json"
SUMMARY_SCHEMA = "section string, name string, path string, rows bigint, target bigint"


def sample_path(root: str, name: str, target: int) -> str:
    return f"{root.rstrip('/')}/pretrain/{name}_{count_label(target)}"


def count_rows(spark: SparkSession, path: str) -> int:
    return spark.read.option("recursiveFileLookup", "true").text(path).count() if exists(spark, path) else 0


def valid_rows(spark: SparkSession, corpus: CorpusSource, paths: list[str], skip: int = 0) -> DataFrame:
    """(ord, text, dataset, source, metadata) from the given files; unused columns are not read.

    Of Parquet files, ``skip`` rows are passed over without reading their row groups.
    """
    if corpus.kind == "jsonl":
        return normalise_json(parse_objects(read_lines(spark, paths)), corpus.name, corpus.text_column)
    if corpus.kind == "parquet":
        columns = [corpus.text_column, *corpus.extra_columns]
        rows = read_rows_after(spark, paths, skip, columns) if skip else read_rows(spark, paths, columns)
        return normalise_columns(rows, corpus.name, corpus.text_column)
    if corpus.kind == "table":
        return normalise_columns(read_table(spark, corpus.table, columns=[corpus.text_column, *corpus.extra_columns]), corpus.name, corpus.text_column)
    raise ValueError(f"unsupported source kind: {corpus.kind}")


def drop_unfinished(spark: SparkSession, path: str) -> None:
    """Remove parts of a sample whose job did not end: they carry no commit mark."""
    for part in children(spark, path):
        if part.startswith("from-") and not exists(spark, f"{path}/{part}/_SUCCESS"):
            delete(spark, f"{path}/{part}")


def _note_position(spark: SparkSession, part: str, file: str, row: int, rows: int) -> None:
    write_file(spark, f"{part}/{POSITION}", json.dumps({"file": file, "row": row, "rows": rows}), overwrite=True)


def _last_position(spark: SparkSession, path: str, existing: int) -> tuple[str, int] | None:
    """(file, row) of the last row of a sample of ``existing`` rows, if its newest part has noted it."""
    marks = [part for part in children(spark, path) if part.startswith("from-") and exists(spark, f"{path}/{part}/{POSITION}")]
    if not marks:
        return None
    noted = json.loads(read_file(spark, f"{path}/{marks[-1]}/{POSITION}"))
    return (noted["file"], noted["row"]) if noted["rows"] == existing else None


def _copy_seed(spark: SparkSession, root: str, name: str, target: int) -> int:
    """Start from the largest existing sample of exactly this name below the target."""
    path = sample_path(root, name, target)
    if exists(spark, path):
        return count_rows(spark, path)
    label = F.element_at(F.split(F.regexp_extract(F.col("path"), r"/pretrain/([^/]+)", 1), f"^{name}_"), -1)
    stored = [p for p in resolve_paths(spark, f"{root.rstrip('/')}/pretrain/{name}_*") if "*" not in p]
    if not stored:
        return 0
    lines = spark.read.text(stored).select(F.col("_metadata.file_path").alias("path"))
    counts = (
        lines.withColumn("label", label).where(F.col("label").rlike("^[0-9]+[km]?$"))
        .groupBy("label").agg(F.count("*").alias("rows"))
        .select(F.lit(name).alias("name"), "label", F.concat(F.lit(f"{root.rstrip('/')}/pretrain/{name}_"), "label").alias("path"), "rows")
    )
    best = pick_seed(counts, target).first()
    if best is None:
        return 0
    copied = read_lines(spark, best.path)
    ordered = copied.repartitionByRange("ord").sortWithinPartitions("ord")
    ordered.select("line").write.text(f"{path}/from-{0:012d}")
    noted = _last_position(spark, best.path, best.rows)
    if noted:
        _note_position(spark, f"{path}/from-{0:012d}", *noted, best.rows)
    return best.rows


def extend_sample(spark: SparkSession, root: str, name: str, target: int, corpus_root: str) -> tuple[str, int]:
    """Append valid rows until the sample has ``target`` of them; what exists is never cut.

    Rows that the sample has are found by count. A part made from Parquet files also notes its last row, so that the next run
    starts behind it and reads nothing before.
    """
    corpus, path = source(name), sample_path(root, name, target)
    drop_unfinished(spark, path)
    existing = _copy_seed(spark, root, name, target)
    if existing >= target:
        return path, existing
    files, skip = skip_known(corpus.paths(corpus_root), corpus.known_counts, existing)
    passed = 0
    if corpus.kind == "parquet":
        every, position = resolve_paths(spark, corpus.paths(corpus_root)), _last_position(spark, path, existing)
        if position and position[0] in every:
            files, skip, passed = every[every.index(position[0]):], 0, position[1] + 1
        else:
            files = resolve_paths(spark, files)
    wanted = target - existing + skip
    if corpus.kind != "table":
        files = leading_files(files, wanted, lambda some: valid_rows(spark, corpus, some, passed if some[:1] == files[:1] else 0).count())
    if files or corpus.kind == "table":
        available = valid_rows(spark, corpus, files, passed)
        ends = spark.createDataFrame([(name, n) for n in {skip, wanted}], "dataset string, n bigint")
        found = {r.n: r.cut for r in cuts(available, "dataset", "ord", ord_bucket(F.col("ord")), ends).collect()}
        # Without a place for the last row to skip there are none to skip, as there is one wherever there are rows.
        new = available.where((F.col("ord") > found.get(skip, -1)) & (F.col("ord") <= found.get(wanted, -1)))
        part = f"{path}/from-{existing:012d}"
        # An empty part of this number may be left by a run that found no rows.
        write_sample_jsonl(new, part, overwrite=True)
        count = count_rows(spark, path)
        if corpus.kind == "parquet" and found.get(wanted):
            last = found[wanted]
            _note_position(spark, part, files[last >> FILE_SHIFT], last & ((1 << FILE_SHIFT) - 1), count)
        return path, count
    return path, count_rows(spark, path)


def extend_samples(spark: SparkSession, root: str, names: list[str], target: int, corpus_root: str, rebuild_mix: bool = True) -> DataFrame:
    """Extend every named source, rebuild the mix in that order and update the summary."""
    for name in names:
        source(name)
    done = [(name, *extend_sample(spark, root, name, target, corpus_root)) for name in names]
    # A source named twice is mixed twice but summed up once.
    rows = [("pretrain", name, path, count, target) for name, path, count in dict.fromkeys(done)]
    if rebuild_mix:
        mixed_path = f"{root.rstrip('/')}/pretrain/mixed_pretrain_sample"
        mixed = mix([read_lines(spark, path) for _, path, _ in done])
        ordered = mixed.repartitionByRange("src_ord", "ord").sortWithinPartitions("src_ord", "ord")
        ordered.select("line").write.mode("overwrite").text(mixed_path)
        rows.append(("pretrain", "mixed_pretrain", mixed_path, sum(count for *_, count in done), None))
    return update_summary(spark, root, spark.createDataFrame(rows, SUMMARY_SCHEMA))


def update_summary(spark: SparkSession, root: str, section: DataFrame) -> DataFrame:
    """Replace the ``pretrain`` section of the stored summary and keep the others."""
    path = f"{root.rstrip('/')}/sample_summary"
    stored = spark.read.schema(SUMMARY_SCHEMA).json(path) if exists(spark, path) else spark.createDataFrame([], SUMMARY_SCHEMA)
    updated = materialise(replace_section(stored, "pretrain", section.drop("section")), "summary")
    updated.coalesce(1).write.mode("overwrite").json(path)  # one row per source
    return updated
