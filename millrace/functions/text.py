"""Text predicates and the byte-level pre-tokeniser as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE_CODES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODES))

# Fixed value: the published byte-level BPE split pattern.
WORD_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def not_blank(col: Column) -> Column:
    """A filter for text that keeps something after stripping."""
    return strip(col) != ""


def not_empty(col: Column) -> Column:
    """The looser filter of tokenizer training: whitespace-only text passes. Scans take it over."""
    return col != ""


def words(col: Column) -> Column:
    """Split text into byte-level pre-tokens; concatenated they give the text back."""
    return F.regexp_extract_all(col, F.lit(WORD_PATTERN), F.lit(0))


def unify_newlines(col: Column) -> Column:
    return F.regexp_replace(col, "\r\n?", "\n")
