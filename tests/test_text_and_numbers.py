import sys

import pytest
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from millrace.functions.byte_symbols import BYTE_IDS, BYTE_SYMBOLS, byte_ids
from millrace.functions.numbers import count_label, count_of, format_count, parse_count, uniform
from millrace.functions.text import WHITESPACE, not_blank, not_empty, strip, words

EDGES = [
    "", " ", "   ", "a", " a", "  a", "a  b", "a \n\n b", "\t　x", "it's we'll I'd they've", "x''s",
    "日本語 テキスト", "٣٤٥ 12", "😀 ok 👩‍👩‍👧", "a\r\nb\r\n", "snake_case __x__", "tail  ", "é́", "\x1c x \x85y", "!!?? ..", "a1b2",
]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_strip_and_blank_tests(spark):
    rows = ["  a ", "　x\x1c", "\n\t", "", None, "b"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(strip(F.col("t")), not_blank(F.col("t")), not_empty(F.col("t"))).collect()
    for row, (stripped, nonblank, nonempty) in zip(rows, got):
        assert stripped == (None if row is None else row.strip())
        assert bool(nonblank) == bool(row and row.strip())
        assert bool(nonempty) == bool(row)


def test_words_match_the_library(spark):
    pre = ByteLevel(add_prefix_space=False, use_regex=True)
    df = spark.createDataFrame([(t,) for t in EDGES], "t string")
    for text, (found,) in zip(EDGES, df.select(words(F.col("t"))).collect()):
        assert [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)] == found
        assert "".join(found) == text


def test_byte_alphabet(spark):
    assert sorted(BYTE_SYMBOLS) == sorted(ByteLevel.alphabet())
    assert sorted(BYTE_IDS) == list(range(1, 257))
    row = spark.createDataFrame([("é a",)], "w string").select(byte_ids(F.col("w")).alias("i")).first()
    assert row.i == [BYTE_IDS[b] for b in "é a".encode()]


def test_counts(spark):
    df = spark.createDataFrame([(s,) for s in ("1m", "500k", "1_000", "1.5m", "999", " 2K ")], "s string")
    assert [r[0] for r in df.select(parse_count(F.col("s"))).collect()] == [1_000_000, 500_000, 1000, 1_500_000, 999, 2000]
    assert [count_of(s) for s in ("1m", "500k", "1_000", "1.5m", "999", " 2K ")] == [1_000_000, 500_000, 1000, 1_500_000, 999, 2000]
    numbers = [0, 999, 1000, 1500, 20_000, 1_000_000, 2_500_000]
    labels = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n bigint").select(format_count(F.col("n"))).collect()]
    assert labels == ["0", "999", "1k", "1500", "20k", "1m", "2500k"] == [count_label(n) for n in numbers]
    with pytest.raises(ValueError):
        count_of("many")


def test_uniform_depends_on_its_parts_only(spark):
    df = spark.range(2000).repartition(7)
    one = dict(df.select("id", uniform(1, "x", F.col("id"))).collect())
    two = dict(spark.range(2000).coalesce(1).select("id", uniform(1, "x", F.col("id"))).collect())
    assert one == two and all(0 <= v < 1 for v in one.values())
    assert abs(sum(one.values()) / 2000 - 0.5) < 0.03
