"""The split pattern of ``functions.text`` for whole Arrow batches, in numpy.

Words tile their text, so they are the text's own bytes with more offsets, and nothing is copied.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LETTER, NUMBER, SPACE, OTHER = b"a1 ."  # classes of characters; each sign is of its own class
_PAGE = 0x800  # code points asked for in one row; surrogates are one page


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point as the JVM's patterns see it, so that both splits agree whatever the Unicode version."""
    pages = [p for p in range(0, 0x110000, _PAGE) if p != 0xD800]
    rows = [(p, "".join(map(chr, range(p, p + _PAGE))).encode()) for p in pages]
    signs = F.col("chars").cast("string")
    for pattern, sign in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE), (r"[^\s\p{L}\p{N}]", OTHER)):
        signs = F.regexp_replace(signs, f"(?U){pattern}", chr(sign))
    out = np.full(0x110000, OTHER, np.uint8)
    for row in SparkSession.active().createDataFrame(rows, "page int, chars binary").select("page", signs.alias("signs")).collect():
        out[row.page : row.page + _PAGE] = np.frombuffer(row.signs.encode(), np.uint8)
    return out


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, code points, byte at which each character begins and the end, first character of each row and the end)."""
    column = column.cast(pa.string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if not len(data) or data.max() < 0x80:
        return data, data, np.arange(len(data) + 1), offsets
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # as the JVM reads bytes that are not UTF-8
        return _characters(pa.array([x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string()))
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return data, points, at, np.searchsorted(at, offsets)


def split_words(column: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, first): the words of all rows of a string column; those of row i are first[i] … first[i + 1] - 1. Null has none."""
    data, points, at, rows = _characters(column)
    n = len(points)
    kind = classes[points]
    opens = np.zeros(n + 1, bool)  # where a row begins, and the end
    opens[rows] = True
    opens[n] = True
    begins = opens.copy()  # where a word begins
    begins[1:n] |= kind[1:] != kind[:-1]
    # The last blank before something else is no part of the blanks before it; a space goes with what follows.
    last = np.flatnonzero((kind == SPACE) & begins[1:] & ~opens[1:])
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    # 's, 't, 'm, 'd, 're, 've and 'll where a word begins with the apostrophe.
    quote = np.flatnonzero((points == 0x27) & begins[:n] & ~opens[1:])
    after = points[quote + 1]
    final = np.minimum(quote + 2, n - 1)
    follows = np.where(opens[np.minimum(quote + 2, n)], 0, points[final])
    short = np.isin(after, np.frombuffer(b"stmd", np.uint8))
    e, l = ord("e"), ord("l")
    long = (((after == ord("r")) | (after == ord("v"))) & (follows == e)) | ((after == l) & (follows == l))
    begins[quote[short | long] + 1] = False
    begins[np.concatenate([quote[short] + 2, quote[long] + 3])] = True
    starts = np.flatnonzero(begins[:n])
    ends = np.append(at[starts], len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.searchsorted(starts, rows)
