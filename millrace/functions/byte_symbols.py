"""The 256-symbol byte alphabet and its vocabulary ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "<unk>"
UNKNOWN_ID = 0
FIRST_MERGE_ID = 257


def symbol_of_byte(value: int) -> str:
    """Printable Latin-1 bytes stand for themselves, the others for code points from 256 up."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    if value in printable:
        return chr(value)
    return chr(256 + [b for b in range(256) if b not in printable].index(value))


BYTE_SYMBOLS = [symbol_of_byte(b) for b in range(256)]
# Ids follow the code points of the symbols; 0 is the unknown token.
BYTE_IDS = [1 + sorted(BYTE_SYMBOLS).index(s) for s in BYTE_SYMBOLS]
BYTE_OF_SYMBOL = {s: b for b, s in enumerate(BYTE_SYMBOLS)}


def byte_ids(word: Column) -> Column:
    """UTF-8 bytes of a word as vocabulary ids (``array<int>``)."""
    table = F.array(*[F.lit(i) for i in BYTE_IDS])
    pairs = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1))

