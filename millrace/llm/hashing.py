"""Words of Arrow string columns as 64-bit hashes, whole batches at a time in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, from random byte values, then mixed. Prefix
sums give the hash of any run of bytes, so the cost is a few passes over the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes of text hashed at once; a longer text is a chunk of its own
_RNG = np.random.Generator(np.random.PCG64(20260701))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, …, n modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, CHUNK + 1), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= CHUNK:
            _powers[int(base)] = known
    return known[: n + 1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * base**j over j < i, for i = 0 … n."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values))[:-1], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), the same for equal runs anywhere."""
    return mix64((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(sums) - 1)[starts])


def utf8_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about CHUNK bytes of a string column, for work that unfolds whole texts in memory."""
    for batch in batches:
        _, offsets = utf8_of(batch.column(column))
        for a, b in chunks_of(offsets):
            yield batch.slice(a, b - a)


def chunks_of(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about CHUNK bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The whitespace-separated words of consecutive rows.

    ``starts`` and ``ends`` are byte places in ``data``; the words of row i are first[i] … first[i + 1] - 1.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        space = SPACES[data]
        begins = np.ones(n + 1, bool)
        begins[1:] = np.append(space, True)[:n]
        begins[offsets] = True  # rows end words
        solid = ~space
        self.starts = np.flatnonzero(solid & begins[:n])
        stops = np.ones(n + 1, bool)
        stops[:n] = space
        stops[offsets] = True
        self.ends = np.flatnonzero(solid & stops[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = run_hashes(prefix_sums(_BYTE[self.data]), self.starts, self.ends) if hashed else None

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k words from each word on; valid if the row has as many."""
        n = len(self.starts)
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        valid = np.arange(n) + k <= row_end
        ends = np.minimum(np.arange(n) + k, n)
        return run_hashes(prefix_sums(self.hashes), np.arange(n), ends), valid


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(a, b, words of rows a … b - 1) over a string column."""
    data, offsets = utf8_of(column)
    for a, b in chunks_of(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, hashed)
