"""Expand path arguments to an ordered file list on any Hadoop file system.

Names are plain: a space, ``%`` or ``[`` in a file name stands for itself. ``readable`` spells a name
for Spark's readers, which take patterns, and ``metadata_name`` as ``_metadata.file_path`` gives it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MOST_FILES = 1 << 23  # what the upper part of ``ord`` can number
GLOB = re.compile(r"([\[\]{}*?\\])")
QUOTED = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\u00A1-\U0010FFFF]")  # in the path part of a URI


def _hadoop_path(spark: SparkSession, value: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(value)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _one_slash(name: str) -> str:
    """Local paths come with one slash or with three; one is used throughout."""
    return re.sub("^file:/+", "file:/", name)


def readable(name: str) -> str:
    """A resolved name for Spark's readers, without its characters acting as a pattern."""
    return GLOB.sub(r"\\\1", name)


def metadata_name(name: str) -> str:
    """A resolved name as ``file_of_row`` spells it."""
    return QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name)


def file_of_row() -> Column:
    """The file a row was read from, in URI form."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def qualified(spark: SparkSession, value: str) -> str:
    """The path with scheme and authority, so that driver and executors mean the same place."""
    path, fs = _hadoop_path(spark, value)
    return _one_slash(fs.makeQualified(path).toString())


def exists(spark: SparkSession, value: str) -> bool:
    path, fs = _hadoop_path(spark, value)
    return fs.exists(path)


def delete(spark: SparkSession, value: str) -> None:
    path, fs = _hadoop_path(spark, value)
    fs.delete(path, True)


def children(spark: SparkSession, value: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    path, fs = _hadoop_path(spark, value)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def write_file(spark: SparkSession, value: str, content: str, overwrite: bool = False) -> None:
    """One small file, as UTF-8."""
    path, fs = _hadoop_path(spark, value)
    out = fs.create(path, overwrite)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def read_file(spark: SparkSession, value: str) -> str:
    """The content of one small file, whatever its name."""
    path, fs = _hadoop_path(spark, value)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _data_files(fs, path) -> list[tuple[str, int]]:
    found = []
    for status in fs.listStatus(path):
        child = status.getPath()
        if child.getName().startswith(("_", ".")):
            continue
        found += _data_files(fs, child) if status.isDirectory() else [(_one_slash(child.toString()), status.getLen())]
    return sorted(found)


def resolve_files(spark: SparkSession, values: str | Iterable[str] | None) -> list[tuple[str, int]]:
    """(name, bytes): argument order is kept, matches are sorted within an argument, duplicates stay.

    A pattern without a match stays as it is, so that reading it reports the missing path.
    A directory stands for the data files below it. A name that exists as it is written is no pattern.
    """
    resolved: list[tuple[str, int]] = []
    for value in [values] if isinstance(values, str) else values or []:
        path, fs = _hadoop_path(spark, value)
        matches = [fs.getFileStatus(path)] if GLOB.search(value) and fs.exists(path) else fs.globStatus(path)
        hits: list[tuple[str, int]] = []
        for status in matches or []:
            hit = status.getPath()
            hits += _data_files(fs, hit) if status.isDirectory() else [(_one_slash(hit.toString()), status.getLen())]
        resolved += sorted(hits) or [(value, 0)]
    if len(resolved) >= MOST_FILES:
        raise ValueError(f"{len(resolved)} files; at most {MOST_FILES - 1} can be read in order")
    return resolved


def resolve_paths(spark: SparkSession, values: str | Iterable[str] | None) -> list[str]:
    return [name for name, _ in resolve_files(spark, values)]
