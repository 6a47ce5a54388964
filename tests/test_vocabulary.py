import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library
from tokenizers.decoders import ByteLevel as ByteDecoder
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel
from tokenizers.trainers import BpeTrainer

from millrace.operators import bpe_train
from millrace.operators.bpe_codec import Tokenizer, choose_dtype
from millrace.operators.bpe_train import train_bpe, vocabulary, word_counts
from millrace.operators.char_codec import CharTokenizer, _offsets, char_vocab


def library(texts, vocab_size):
    tok = Library(BPE(unk_token="<unk>"))
    tok.pre_tokenizer, tok.decoder = ByteLevel(add_prefix_space=False), ByteDecoder()
    trainer = BpeTrainer(vocab_size=vocab_size, special_tokens=["<unk>"], initial_alphabet=ByteLevel.alphabet(), show_progress=False)
    tok.train_from_iterator(texts, trainer=trainer)
    return tok


def merges_of(tok):
    return [tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]


def spelled(merges):
    token = dict(vocabulary(merges))
    return [(token[m.left], token[m.right]) for m in merges]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord bigint, text string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_training_equals_the_library(spark, seed, monkeypatch):
    monkeypatch.setattr(bpe_train, "ROUNDS_PER_WRITE", 4)
    rng = random.Random(seed)
    syllables = ["an", "the", "ou", "ring", "st", "é", "日本", "aaaa", "zz"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(60)) for _ in range(12)]
    tok = library(texts, 257 + 60)
    merges = train_bpe(word_counts(frame(spark, texts)), 257 + 60)
    assert spelled(merges) == merges_of(tok)
    assert dict((t, i) for i, t in vocabulary(merges)) == tok.get_vocab()


@pytest.mark.parametrize(("pool", "candidates"), [(1, 1), (7, 3), (60, 512)])
def test_training_with_a_small_pool_of_pairs(spark, pool, candidates, monkeypatch):
    """Pairs outside the pool, new ones and those counted anew give the same merges."""
    monkeypatch.setattr(bpe_train, "POOL", pool)
    monkeypatch.setattr(bpe_train, "CANDIDATES", candidates)
    counted, count = [], bpe_train._ranked_pairs
    monkeypatch.setattr(bpe_train, "_ranked_pairs", lambda symbols: counted.append(1) or count(symbols))
    rng = random.Random(8)
    syllables = ["an", "the", "ou", "ing", "aaa", "he", "t", "é"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(40)) for _ in range(8)]
    assert spelled(train_bpe(word_counts(frame(spark, texts)), 257 + 40)) == merges_of(library(texts, 257 + 40))
    assert len(counted) <= {1: 40, 7: 20, 60: 3}[pool]


def test_many_merges_equal_the_library(spark):
    rng = random.Random(11)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    syllables = ["".join(rng.choices(letters, range(26, 0, -1), k=rng.randint(1, 4))) for _ in range(400)]
    texts = [" ".join("".join(rng.choices(syllables, range(400, 0, -1), k=rng.randint(1, 3))) for _ in range(500)) for _ in range(40)]
    merges = train_bpe(word_counts(frame(spark, texts)), 257 + 2048)
    assert len(merges) == 2048 and spelled(merges) == merges_of(library(texts, 257 + 2048))


def test_training_ends_when_no_pair_is_left(spark):
    merges = train_bpe(word_counts(frame(spark, ["ab ab cd", "a"])), 5000)
    assert spelled(merges) == merges_of(library(["ab ab cd", "a"], 5000))


def test_no_documents_give_no_merges(spark):
    assert train_bpe(word_counts(frame(spark, ["x"]).where("ord < 0")), 300) == []


def test_vocabulary_size_is_checked(spark):
    with pytest.raises(ValueError):
        train_bpe(word_counts(frame(spark, ["ab"])), 100)


def test_encode_and_decode_equal_the_library(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcde aé日 \n'", k=rng.randint(0, 300))) for _ in range(80)]
    tok = library(texts[:40], 257 + 80)
    coder = Tokenizer(train_bpe(word_counts(frame(spark, texts[:40])), 257 + 80))
    coder.save(spark, str(tmp_path / "t"))
    again = Tokenizer.load(spark, str(tmp_path / "t"))
    assert again == coder and again.vocab_size == tok.get_vocab_size()
    texts += [None, "", "never seen: ωψ 😀"]
    coded = frame(spark, texts).withColumn("ids", again.encode(F.col("text"))).withColumn("back", again.decode(F.col("ids")))
    for row in coded.collect():
        if row.text is not None:
            assert row.ids == tok.encode(row.text).ids and row.back == row.text
        else:
            assert not row.ids


def test_parts_are_encoded_apart(spark):
    texts = ["hi.<|im_end|>\n"] * 5
    coder = Tokenizer(train_bpe(word_counts(frame(spark, texts)), 257 + 20))
    df = spark.createDataFrame([(["hi.", "<|im_end|>\n"],), (["", "x"],), ([],)], "p array<string>")
    rows = [r[0] for r in df.select(coder.encode_parts(F.col("p"))).collect()]
    alone = [r[0] for r in frame(spark, ["hi.", "<|im_end|>\n", "", "x"]).orderBy("ord").select(coder.encode(F.col("text"))).collect()]
    assert rows == [alone[:2], alone[2:], []]


def test_dtype(spark):
    assert choose_dtype(65_535) == "uint16" and choose_dtype(65_536) == "uint32"
    assert choose_dtype(65_536, "uint16") == "uint16"
    with pytest.raises(ValueError):
        choose_dtype(65_537, "uint16")
    with pytest.raises(ValueError):
        choose_dtype(10, "int8")


def test_characters(spark):
    texts = ["hello", "日本😀", "a\nb"]
    df = frame(spark, texts)
    expected = {ch: i for i, ch in enumerate(sorted(set("".join(texts))))}
    assert dict(char_vocab(df).collect()) == expected
    coder = CharTokenizer.of(df)
    rows = df.withColumn("ids", coder.encode(F.col("text"))).withColumn("back", coder.decode(F.col("ids"))).collect()
    for row in rows:
        assert row.ids == [expected[ch] for ch in row.text] and row.back == row.text
    with pytest.raises(Exception, match="outside the vocabulary"):
        frame(spark, ["Z"]).select(coder.encode(F.col("text"))).collect()


def test_offsets_do_not_wrap():
    assert _offsets(np.array([0, 2**31 - 1])).tolist() == [0, 2**31 - 1]
    with pytest.raises(OverflowError, match="maxRecordsPerBatch"):
        _offsets(np.array([0, 5, 2**31]))
