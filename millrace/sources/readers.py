"""Readers that give every row an order-preserving ``ord``.

Shard boundaries and limits depend on path order and then on row order, which a DataFrame
does not keep by itself. ``ord`` is a unique BIGINT that sorts the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType

from millrace.functions.text import not_blank, unify_newlines
from millrace.operators.prefix import with_sum_before
from millrace.session import materialise
from millrace.sources.paths import file_of_row, metadata_name, readable, resolve_files, resolve_paths
from millrace.sources.stores import opened_parquet, row_groups

FILE_SHIFT = 40  # up to 2**40 rows in a file and 2**23 files
BATCH_ROWS = 4096
LONGEST_TEXT = 1 << (FILE_SHIFT - 1)  # bytes of a text file whose lines can be numbered


def _file_positions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, file_idx); a path given twice has two positions and so reads twice.

    The list is the driver's own, of one entry for each file, and goes to every task.
    """
    table = pd.DataFrame({"file": [metadata_name(p) for p in paths], "file_idx": range(len(paths))})
    return F.broadcast(spark.createDataFrame(table, "file string, file_idx bigint"))


def _ordered(rows: DataFrame, paths: list[str], position: Column) -> DataFrame:
    positions = _file_positions(rows.sparkSession, paths)
    return (
        rows.join(positions, "file")
        .withColumn("ord", F.shiftleft("file_idx", FILE_SHIFT) + position)
        .drop("file", "file_idx")
    )


def read_text(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(ord, text): each whole file is one document, with unified line ends."""
    files = resolve_paths(spark, paths)
    rows = spark.read.text([readable(f) for f in sorted(set(files))], wholetext=True)
    rows = rows.select(file_of_row().alias("file"), unify_newlines(F.col("value")).alias("text"))
    return _ordered(rows, files, F.lit(0)).select("ord", "text")


@F.pandas_udf(LongType())
def _line_of_split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Number the rows of each file split, which come one after the other in a partition."""
    current, first = None, 0
    for split, row_id in batches:
        fresh = split.ne(split.shift(fill_value=current)) if current is not None else split.ne(split.shift())
        begin = row_id.where(fresh).ffill().fillna(first).astype("int64")
        if len(split):
            current, first = split.iloc[-1], begin.iloc[-1]
        yield row_id - begin


def number_lines(rows: DataFrame) -> DataFrame:
    """Add ``number``, a line's place in its split, to rows (file, start, line) as a scan gives them."""
    marked = rows.withColumn("id", F.monotonically_increasing_id())
    return marked.withColumn("number", _line_of_split(F.xxhash64("file", "start"), "id"))


def with_fixed_splits(rows: DataFrame) -> DataFrame:
    """The same rows over file splits that are decided now.

    A file scan is planned anew by each action, from the settings and core count of that moment, so places counted in
    one action may not hold in the next. A frame made of the scan's partitions always has these. Nothing is read or written here, and a lost
    partition is read again from the same bytes.
    """
    spark = rows.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD(), rows._jdf.schema()), spark)


def read_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(ord, line): the lines of text files that are not blank.

    Text files have no row index. A line is placed at twice the byte at which its split
    starts plus its number in the split; as every line has a byte or more, this is unique
    and rises with the lines. It takes one pass and no shuffle, and neither moves nor copies a line. Splits are
    fixed when this is called, so that each action on the result finds the same places.
    """
    found = resolve_files(spark, paths)
    for name, size in found:
        if size >= LONGEST_TEXT:
            raise ValueError(f"{name} has {size} bytes; lines are numbered in files below {LONGEST_TEXT} bytes")
    files = [name for name, _ in found]
    rows = spark.read.text([readable(f) for f in sorted(set(files))]).select(
        file_of_row().alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"),
    )
    placed = number_lines(with_fixed_splits(rows)).where(not_blank(F.col("line")))
    return _ordered(placed, files, F.col("start") * 2 + F.col("number")).select("ord", "line")


def leading_files(files: list[str], needed: int, rows_of: Callable[[list[str]], int]) -> list[str]:
    """The leading files that hold ``needed`` rows; more files are counted at each step.

    A small part of a large corpus thus opens a few files and not all of them.
    """
    kept, found, step = 0, 0, 1
    while kept < len(files) and found < needed:
        found += rows_of(files[kept : kept + step])
        kept, step = kept + step, step * 2
    return files[:kept]


def read_rows(spark: SparkSession, paths: str | Iterable[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet rows with ``ord``; ``columns`` prunes the scan."""
    files = resolve_paths(spark, paths)
    return _with_row_index(spark.read.parquet(*[readable(f) for f in sorted(set(files))]), files, columns)


def read_rows_after(spark: SparkSession, paths: str | Iterable[str], skip: int, columns: list[str]) -> DataFrame:
    """``read_rows`` without the first ``skip`` rows of all files, whose row groups are not read.

    Footers tell the rows of each group; sums of these, in two levels, tell which group holds the first row wanted. Groups
    before it aren't opened, it is read from that row on, and later ones whole, each by one task.
    """
    files = resolve_paths(spark, paths)
    if not files:
        return read_rows(spark, paths, columns)
    stored = spark.read.parquet(*[readable(f) for f in sorted(set(files))])
    schema = stored.select(*_present(stored, columns)).schema
    place = F.shiftleft("file_idx", 20) + F.col("row_group")
    groups = materialise(row_groups(spark, files).where("num_rows > 0").withColumns({"_all": F.lit(0), "place": place}), "row-groups")
    summed = materialise(with_sum_before(groups, "_all", "place", "num_rows", "before"), "row-groups")
    placed = with_sum_before(summed, "file_idx", "place", "num_rows", "first")
    rest = placed.where(F.col("before") + F.col("num_rows") > skip)
    rest = materialise(rest.select("file", "row_group", F.greatest(F.lit(skip) - F.col("before"), F.lit(0)).alias("offset"), (F.shiftleft("file_idx", FILE_SHIFT) + F.col("first")).alias("base")), "row-groups")
    own = [c for c in columns if c in stored.columns]
    out = schema.add("ord", LongType())
    kinds = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            at, offset = row["base"], row["offset"]
            with opened_parquet(row["file"]) as file:
                for batch in file.iter_batches(BATCH_ROWS, row_groups=[row["row_group"]], columns=own):
                    ords = pa.array(range(at, at + len(batch)), pa.int64())
                    at += len(batch)
                    values = [batch.column(c) if c in batch.schema.names else pa.nulls(len(batch)) for c in columns]
                    whole = pa.RecordBatch.from_arrays([v.cast(k.type) for v, k in zip([*values, ords], kinds, strict=True)], schema=kinds)
                    left = whole.slice(offset)
                    offset = max(0, offset - len(whole))
                    if len(left):
                        yield left

    return rest.repartition(max(1, rest.count())).mapInArrow(scan, out)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Spread rows over the cores before costly per-row work, where they come from few row groups.

    A row group is read by one task whatever its size. Inputs of many files need no such shuffle.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def read_table(
    spark: SparkSession,
    name: str,
    split: str | None = "train",
    split_column: str = "split",
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows of a catalogue table in file order; ``split`` filters when the table has that column."""
    table = spark.table(name)
    ordered = _with_row_index(table, resolve_paths(table.sparkSession, sorted(table.inputFiles())), None)
    if split is not None and split_column in table.columns:
        ordered = ordered.where(F.col(split_column) == split)
    return ordered if columns is None else ordered.select("ord", *_present(table, columns))


def _present(rows: DataFrame, columns: list[str]) -> list[Column]:
    """An absent column is null."""
    return [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]


def _with_row_index(rows: DataFrame, files: list[str], columns: list[str] | None) -> DataFrame:
    wanted = _present(rows, columns if columns is not None else rows.columns)
    indexed = rows.select(
        file_of_row().alias("file"), F.col("_metadata.row_index").alias("row_index"), *wanted
    )
    return _ordered(indexed, files, F.col("row_index")).drop("row_index")


def json_field(row: Column, name: str) -> Column:
    """A top-level field of a JSON object as VARIANT."""
    quoted = name.replace("'", "\\'")
    return F.variant_get(row, f"$['{quoted}']", "variant")


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def string_field(row: Column, name: str) -> Column:
    """The field if it is a JSON string; numbers, arrays and objects give null."""
    value = json_field(row, name)
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def parse_objects(lines: DataFrame) -> DataFrame:
    """(ord, row VARIANT). Malformed JSON and rows that are not objects fail the job."""
    is_object = F.startswith(F.ltrim(F.col("line")), F.lit("{"))
    row = F.when(is_object, F.parse_json("line")).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 80))).cast("variant")
    )
    return lines.select("ord", row.alias("row"))


def read_documents(
    spark: SparkSession,
    kind: str,
    paths: str | Iterable[str] | None = None,
    text_column: str = "text",
    table: str | None = None,
    split: str | None = "train",
    first: int | None = None,
) -> DataFrame:
    """(ord, text) of one source. Whole files keep blank text, the other kinds drop it.

    ``first``: only files up to the one that holds the document of this number are opened. The documents
    after it in that file stay; ``limit_rows`` drops them.
    """
    check_source(kind, paths, table)
    if kind == "table":
        rows = _text_only(read_table(spark, table, split, columns=[text_column]), text_column)
        return rows.where(not_blank(F.col("text")))

    def documents(files) -> DataFrame:
        if kind == "text":
            return read_text(spark, files)
        if kind == "jsonl":
            rows = parse_objects(read_lines(spark, files)).select("ord", string_field(F.col("row"), text_column).alias("text"))
        else:
            rows = _text_only(read_rows(spark, files, [text_column]), text_column)
        return rows.where(not_blank(F.col("text")))

    if first is None:
        return documents(paths)
    files = resolve_paths(spark, paths)
    return documents(leading_files(files, max(1, first), lambda some: documents(some).count()) or files)


def _text_only(rows: DataFrame, column: str) -> DataFrame:
    """(ord, text); a column of another type has no text."""
    is_text = isinstance(rows.schema[column].dataType, StringType)
    text = F.col(f"`{column}`") if is_text else F.lit(None).cast("string")
    return rows.select("ord", text.alias("text"))


def check_source(kind: str, paths=None, table: str | None = None) -> None:
    """Report a bad source before any job runs."""
    if kind not in ("text", "jsonl", "parquet", "table"):
        raise ValueError(f"unknown source kind: {kind}")
    if kind == "table" and not table:
        raise ValueError("a table source needs a table name")
    if kind != "table" and not paths:
        raise ValueError(f"a {kind} source needs at least one path")
