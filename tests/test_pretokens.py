import random

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions.pretokens import char_classes, split_words
from millrace.functions.text import words
from millrace.operators import bpe_codec
from millrace.operators.bpe_train import word_counts

PIECES = list("ab é\t\n'12.,") + [
    "'s", "'re", "'ll", "'lx", "'v", "'ve", "'m", "'d", "'T", " 's", "  's", "\t's", "''s", "  ", " \t", "\t ", "　", " ", "  ",
    "́", "中", "\U0001d7d8", "\U0001f600", "½", "_", "\x1c", "\x85", "​", "\r\n", "�", "don't", "we'll",
]


def _texts(n):
    draw = random.Random(5)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, 12))) for _ in range(n)]


def _split(column):
    found, first = split_words(column, char_classes())
    found = found.to_pylist()
    return [found[a:b] for a, b in zip(first, first[1:])]


def test_batches_are_split_as_by_the_pattern(spark):
    texts = ["", None, " ", "'", "a'", "'s", "it's's", *PIECES, *_texts(5000), "end ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    right = [r[0] or [] for r in rows.orderBy("id").select(words(F.col("text"))).collect()]
    column = pa.array(texts, pa.string())
    assert _split(column) == right
    assert _split(column.slice(3, 900)) == right[3:903]
    plain = [t for t in texts if t is None or t.isascii()]
    assert _split(pa.array(plain, pa.string())) == [r for t, r in zip(texts, right) if t is None or t.isascii()]
    assert _split(pa.array([], pa.string())) == [] and _split(pa.array([None, ""], pa.string())) == [[], []]


def test_every_character_has_the_class_of_the_pattern(spark):
    texts = ["".join(map(chr, range(p, p + 256))) for p in range(0, 0x30000, 256) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert _split(pa.array(texts)) == [r[0] for r in rows.orderBy("id").select(words(F.col("text"))).collect()]


def test_bytes_that_are_not_utf8_read_as_by_the_jvm(spark):
    raw = [b"ab \xff c", b"\xe2\x82 x", b"\xf0\x9f\x98", "é 1".encode(), None]
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw binary").select("id", F.col("raw").cast("string").alias("text"))
    right = [r[0] or [] for r in rows.orderBy("id").select(words(F.col("text"))).collect()]
    offsets = pa.py_buffer(pa.array(raw, pa.binary()).buffers()[1])
    assert _split(pa.StringArray.from_buffers(4, offsets, pa.array(raw, pa.binary()).buffers()[2])) == right[:4]


def test_counting_and_encoding_unfold_no_words_in_the_jvm(spark, capsys):
    """A row for each word of the corpus, or a list of them, was what most of the time went into."""
    texts = [*_texts(300), None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = word_counts(rows)
    coded = rows.select(bpe_codec.Tokenizer([]).encode(F.col("text")).alias("ids"))
    for frame in (counted, coded):
        frame.explain()
        plan = capsys.readouterr().out
        assert "regexp_extract_all" not in plan and "Generate" not in plan
    exploded = rows.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").count()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, exploded.collect()))
