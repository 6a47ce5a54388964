"""Character vocabulary: the sorted distinct characters of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _distinct(documents: DataFrame, text: str) -> DataFrame:
    """(ch): each document gives each of its characters once."""
    return documents.select(F.explode(F.array_distinct(F.split(text, ""))).alias("ch")).where("ch <> ''").distinct()


def char_vocab(documents: DataFrame, text: str = "text") -> DataFrame:
    """(ch, id) in code-point order. There are at most 1,114,112 code points."""
    distinct = _distinct(documents, text)
    return distinct.withColumn("id", F.row_number().over(Window.orderBy("ch")) - 1)


def _offsets(ends: np.ndarray) -> np.ndarray:
    """Offsets of a list or string column, which have 32 bits; a batch that needs more fails."""
    if len(ends) and ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"a batch has {ends[-1]} elements; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return ends.astype(np.int32)


@dataclass(frozen=True)
class CharTokenizer:
    """Sorted code points; an id is a position in them."""

    points: tuple[int, ...]

    @classmethod
    def of(cls, documents: DataFrame, text: str = "text") -> CharTokenizer:
        chars = _distinct(documents, text).collect()
        return cls(tuple(sorted(ord(row.ch) for row in chars)))

    @property
    def vocab_size(self) -> int:
        return len(self.points)

    def encode(self, text: Column) -> Column:
        """``array<int>``; a character outside the vocabulary fails the job."""
        points = np.array(self.points, np.uint32)

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            joined = "".join(v for v in texts.to_pylist() if v is not None)
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            ids = np.searchsorted(points, codes).clip(max=max(len(points) - 1, 0))
            if len(codes) and (len(points) == 0 or (points[ids] != codes).any()):
                raise ValueError("text has a character outside the vocabulary")
            ends = _offsets(np.concatenate([[0], np.cumsum(lengths)]))
            mask = texts.is_null() if texts.null_count else None
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)), mask=mask)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        points = np.array(self.points, np.uint32)

        @F.arrow_udf("string")
        def decode(rows: pa.Array) -> pa.Array:
            chosen = points[rows.flatten().to_numpy(zero_copy_only=False)]
            sizes = 1 + (chosen >= 0x80).astype(np.int64) + (chosen >= 0x800) + (chosen >= 0x10000)  # bytes in UTF-8
            byte_ends = np.concatenate([[0], np.cumsum(sizes)])
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            ends = _offsets(byte_ends[np.concatenate([[0], np.cumsum(lengths)])])
            letters = chosen.tobytes().decode("utf-32-le").encode()
            text = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(letters))
            return pc.if_else(rows.is_null(), pa.scalar(None, pa.string()), text) if rows.null_count else text

        return decode(ids)
