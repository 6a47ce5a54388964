"""Per-source samples: normalised rows, resume points, top-up to a target and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import not_blank
from millrace.operators.chat import truthy
from millrace.operators.cutoffs import ord_bucket, take_between
from millrace.sources.readers import json_field, string_field

SAMPLE = ("text", "dataset", "source", "metadata")


def normalise_json(rows: DataFrame, dataset: Column | str, text_column: str = "text") -> DataFrame:
    """(ord, text, dataset, source, metadata) of JSON rows; rows without text are dropped.

    ``source`` is the row's own if it is not empty, else that of its metadata object.
    """
    row = F.col("row")
    own, metadata = json_field(row, "source"), json_field(row, "metadata")
    label = F.lit(dataset) if isinstance(dataset, str) else dataset
    return rows.select(
        "ord",
        string_field(row, text_column).alias("text"),
        label.alias("dataset"),
        F.when(truthy(own), own).otherwise(F.try_variant_get(metadata, "$.source", "variant")).alias("source"),
        metadata.alias("metadata"),
    ).where(not_blank(F.col("text")))


def normalise_columns(rows: DataFrame, dataset: Column | str, text_column: str = "text") -> DataFrame:
    """The same for tabular rows, which carry no metadata."""
    label = F.lit(dataset) if isinstance(dataset, str) else dataset
    is_text = text_column in rows.columns and isinstance(rows.schema[text_column].dataType, StringType)
    text = F.col(f"`{text_column}`") if is_text else F.lit(None).cast("string")  # numbers are no text
    own = F.nullif(F.col("source").cast("string"), F.lit("")) if "source" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "ord", text.alias("text"), label.alias("dataset"), own.alias("source"), F.lit(None).cast("string").alias("metadata")
    ).where(not_blank(F.col("text")))


def existing_counts(existing: DataFrame, key: str = "dataset") -> DataFrame:
    return existing.groupBy(key).agg(F.count("*").alias("existing"))


def missing_rows(available: DataFrame, existing: DataFrame, target: int) -> DataFrame:
    """The valid rows that lift every dataset to ``target``: skip what it has, then take the rest.

    ``available`` is (ord, dataset, ...) and ``existing`` is (dataset, existing). A dataset
    that has enough gets nothing.
    """
    have = F.coalesce("existing", F.lit(0))
    datasets = available.select("dataset").distinct().join(existing, "dataset", "left")
    wanted = datasets.where(have < target).select("dataset", have.cast("bigint").alias("skip"), F.lit(target).cast("bigint").alias("n"))
    return take_between(available, "dataset", "ord", ord_bucket(F.col("ord")), wanted)


def top_up(available: DataFrame, existing: DataFrame, target: int) -> DataFrame:
    """Existing rows, never cut, and the missing ones."""
    new = missing_rows(available, existing_counts(existing), target)
    return existing.unionByName(new, allowMissingColumns=True)


def skip_known(paths: list[str], known_counts: dict[str, int], skip: int) -> tuple[list[str], int]:
    """Drop files whose known number of valid rows lies wholly before the resume point."""
    kept = []
    for path in paths:
        known = known_counts.get(path.rsplit("/", 1)[-1])
        if known is not None and skip >= known:
            skip -= known
        else:
            kept.append(path)
    return kept, skip


def mix(samples: list[DataFrame]) -> DataFrame:
    """All rows of all samples; ``src_ord`` keeps the order of the samples. Duplicates stay."""
    if not samples:
        raise ValueError("nothing to mix")
    numbered = [s.withColumn("src_ord", F.lit(i)) for i, s in enumerate(samples)]
    mixed = numbered[0]
    for more in numbered[1:]:
        mixed = mixed.unionByName(more, allowMissingColumns=True)
    return mixed


def pick_seed(candidates: DataFrame, target: int) -> DataFrame:
    """(name, path, rows): per name the largest sample below ``target``, the first path of equal ones."""
    fitting = candidates.where((F.col("rows") > 0) & (F.col("rows") < target))
    best = fitting.groupBy("name").agg(F.min(F.struct((-F.col("rows")).alias("less"), "path")).alias("b"))
    return best.select("name", F.col("b.path").alias("path"), (-F.col("b.less")).alias("rows"))


def sample_summary(rows: DataFrame, target: int) -> DataFrame:
    """(name, rows, target) per dataset and for the mix of all."""
    per = rows.groupBy(F.col("dataset").alias("name")).agg(F.count("*").alias("rows")).withColumn("target", F.lit(target).cast("bigint"))
    # The mix is the sum of the per-dataset counts, so the rows are counted once.
    mixed = per.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"))
    return per.unionByName(mixed.select(F.lit("mixed_pretrain").alias("name"), "rows", F.lit(None).cast("bigint").alias("target")))


def replace_section(summary: DataFrame, section: str, rows: DataFrame) -> DataFrame:
    """``summary`` with the rows of one section replaced; the other sections stay."""
    kept = summary.where(F.col("section") != section)
    return kept.unionByName(rows.withColumn("section", F.lit(section)), allowMissingColumns=True)
