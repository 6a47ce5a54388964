"""Byte-wise access from Python tasks, for what Spark's readers can't do: single ranges, footers and row groups.

Arrow's own store clients open the files, with the credentials of the environment they run in and not those of
the Hadoop configuration. Stores that Arrow doesn't know raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.paths import metadata_name

FOOTERS_PER_TASK = 64

# Hadoop schemes and those of the same stores in Arrow.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a qualified path, with its scheme."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"files on {scheme} can only be read by Spark: {path}")
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{metadata_name(rest)}")


def folder_files(root: str, recursive: bool = False) -> list[str]:
    """Paths of the files in a folder, relative to it and sorted; none if it is missing. One listing call for each folder and none for a file."""
    store, base = open_store(root)
    found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=recursive))
    return sorted(f.path[len(base.rstrip("/")) + 1 :] for f in found if f.type == pafs.FileType.File)


class opened_parquet:
    """A Parquet file and the handle below it, closed together."""

    def __init__(self, path: str):
        store, inner = open_store(path)
        self.handle = store.open_input_file(inner)

    def __enter__(self) -> pq.ParquetFile:
        return pq.ParquetFile(self.handle)

    def __exit__(self, *_) -> None:
        self.handle.close()


def row_groups(spark: SparkSession, files: list[str], column: str | None = None) -> DataFrame:
    """(file_idx, file, row_group, num_rows, least) of Parquet files: one row for each row group, from the footers alone.

    Footers are opened by tasks. ``least`` is the smallest value of an integer ``column`` in the group, null where it is not known.
    """

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened_parquet(name) as file:
                    found = file.metadata
                    of = {found.schema.column(i).path: i for i in range(found.num_columns)}
                    for g in range(found.num_row_groups):
                        group = found.row_group(g)
                        facts = group.column(of[column]).statistics if column in of else None
                        rows.append((at, name, g, group.num_rows, facts.min if facts is not None and facts.has_min_max else None))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file_idx", "file", "row_group", "num_rows", "least"])

    tasks = max(1, math.ceil(len(files) / FOOTERS_PER_TASK))
    listed = spark.createDataFrame(list(enumerate(files)), "file_idx bigint, file string").repartition(tasks)
    return listed.mapInArrow(footers, "file_idx bigint, file string, row_group int, num_rows bigint, least bigint")
