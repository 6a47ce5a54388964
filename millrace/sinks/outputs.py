"""Output checks and JSON-lines sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.paths import delete, exists


def require_free(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Fail on an output that exists, before any job runs. It touches nothing; writers replace when asked to."""
    if not overwrite and exists(spark, path):
        raise FileExistsError(f"{path} is there already; pass overwrite=True to replace it")


def save_mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def clear(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Make way for a writer without save modes."""
    require_free(spark, path, overwrite)
    delete(spark, path)


def _write_lines(rows: DataFrame, line: Column, path: str, mode: str) -> None:
    """Part files in ``ord`` order, so that path order and line order give the row order back."""
    ordered = rows.repartitionByRange("ord").sortWithinPartitions("ord")
    ordered.select(line.alias("value")).write.mode(mode).text(path)


def write_chat_jsonl(converted: DataFrame, path: str, overwrite: bool = False) -> None:
    """Converted chat rows; absent fields are left out."""
    require_free(converted.sparkSession, path, overwrite)
    fields = [c for c in converted.columns if c != "ord"]
    _write_lines(converted.where("text IS NOT NULL"), F.to_json(F.struct(*fields)), path, save_mode(overwrite))


def write_sample_jsonl(rows: DataFrame, path: str, append: bool = False, overwrite: bool = False) -> None:
    """Normalised rows; null fields are written."""
    line = F.to_json(F.struct("text", "dataset", "source", "metadata"), {"ignoreNullFields": "false"})
    _write_lines(rows, line, path, "append" if append else save_mode(overwrite))
