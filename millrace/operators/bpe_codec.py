"""Apply a BPE vocabulary: encode and decode as narrow, Arrow-batched projections.

Texts are split in Python, a batch at once. The distinct words of a batch that were not met
before are encoded, and the ids are put together by array indexing. Nothing is shuffled, so encoding
costs one pass over the text at any size, and hot words cost nothing extra.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.byte_symbols import BYTE_IDS, BYTE_SYMBOLS, FIRST_MERGE_ID, UNKNOWN, UNKNOWN_ID
from millrace.functions.merging import RankTable, merge_words, take_runs
from millrace.functions.pretokens import char_classes, split_words
from millrace.operators.bpe_train import MAX_VOCABULARY, Merge, vocabulary
from millrace.sources.paths import readable, resolve_files, write_file

WORD_CACHE = 200_000  # distinct words one Python worker remembers
LARGEST_JSON = 256 << 20  # bytes of a vocabulary file, which the driver reads


@dataclass(frozen=True)
class Tokenizer:
    """A trained vocabulary; small by construction (``vocab_size`` entries)."""

    merges: list[Merge] = field(repr=False)

    @property
    def vocab_size(self) -> int:
        return max([FIRST_MERGE_ID - 1, *[m.new_id for m in self.merges]]) + 1

    def vocabulary_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(vocabulary(self.merges), "id int, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(m.rank, m.left, m.right, m.new_id, m.count) for m in self.merges]
        return spark.createDataFrame(rows, "rank int, l int, r int, new_id int, cnt bigint")

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        mode = "overwrite" if overwrite else "errorifexists"
        self.vocabulary_table(spark).coalesce(1).write.mode(mode).parquet(f"{path}/vocab")
        self.merge_table(spark).coalesce(1).write.mode(mode).parquet(f"{path}/merges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        table = spark.read.parquet(f"{path}/merges")
        if table.count() > MAX_VOCABULARY:
            raise ValueError(f"more than {MAX_VOCABULARY} merges in {path}")
        rows = table.orderBy("rank").collect()
        return cls([Merge(r["rank"], r["l"], r["r"], r["new_id"], r["cnt"]) for r in rows])

    def save_json(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        """The vocabulary and merges as one JSON file in the form of the public tokenizer library."""
        tokens = dict(vocabulary(self.merges))
        model = {
            "type": "BPE", "unk_token": UNKNOWN, "vocab": {token: i for i, token in tokens.items()},
            "merges": [[tokens[m.left], tokens[m.right]] for m in self.merges],
        }
        pieces = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        special = {"id": UNKNOWN_ID, "content": UNKNOWN, "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
        content = {"version": "1.0", "added_tokens": [special], "pre_tokenizer": pieces, "decoder": pieces, "model": model}
        write_file(spark, path, json.dumps(content, ensure_ascii=False), overwrite)

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> Tokenizer:
        """From such a file. Its ids must be those of this byte alphabet: the unknown token, the bytes in order, merges."""
        files = resolve_files(spark, path)
        if len(files) != 1 or files[0][1] > LARGEST_JSON:
            raise ValueError(f"{path} must be one file of at most {LARGEST_JSON} bytes")
        model = json.loads(spark.read.text(readable(files[0][0]), wholetext=True).first()[0])["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if vocab.get(UNKNOWN) != UNKNOWN_ID or any(vocab.get(s) != i for s, i in zip(BYTE_SYMBOLS, BYTE_IDS, strict=True)):
            raise ValueError(f"{path} does not number the unknown token and the byte alphabet from 0 in order")
        return cls([Merge(rank, vocab[a], vocab[b], vocab[a + b], 0) for rank, (a, b) in enumerate(merges)])

    def encode(self, text: Column) -> Column:
        """``array<int>`` of ids; text is pre-tokenised whole."""
        coded = _coder(self)

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return coded(texts)

        return encode(text)

    def encode_parts(self, parts: Column) -> Column:
        """Encode every element of an ``array<string>`` on its own (``array<array<int>>``)."""
        coded = _coder(self)

        @F.arrow_udf("array<array<int>>")
        def encode(rows: pa.Array) -> pa.Array:
            row_ends = np.concatenate([[0], np.cumsum(_sizes(rows))])
            mask = rows.is_null() if rows.null_count else None
            return pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), coded(rows.flatten()), mask=mask)

        return encode(parts)

    def decode(self, ids: Column) -> Column:
        return _decoder(self)(ids)


def encode_words(found: list[str], table: RankTable) -> list[bytes]:
    """The ids of every word as packed int32."""
    raw = [w.encode("utf-8") for w in found]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ids = np.array(BYTE_IDS, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
    ids, word = merge_words(ids, np.repeat(np.arange(len(raw)), sizes), table)
    ends = np.searchsorted(word, np.arange(len(raw)), side="right") * 4
    packed = ids.tobytes()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


def _coder(tokenizer: Tokenizer) -> Callable[[pa.Array], pa.Array]:
    """The ids of each string as a list; those of null are none."""
    table = RankTable([(m.left, m.right, m.new_id) for m in tokenizer.merges])
    shared = SparkSession.active().sparkContext.broadcast((table, char_classes()))
    cache: dict[str, bytes] = {}

    def coded(texts: pa.Array) -> pa.Array:
        table, classes = shared.value
        inner, first = split_words(texts, classes)
        coded = inner.dictionary_encode()
        found = coded.dictionary.to_pylist()
        unseen = [w for w in found if w not in cache]
        fresh = dict(zip(unseen, encode_words(unseen, table)))
        known = [fresh[w] if w in fresh else cache[w] for w in found]
        if len(cache) + len(fresh) > WORD_CACHE:
            cache.clear()
        cache.update((w, ids) for w, ids in fresh.items() if len(ids) <= 256)  # long words seldom come again
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.int32)
        pick = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        tokens = flat[take_runs(starts[pick], lengths[pick])]
        word_ends = np.concatenate([[0], np.cumsum(lengths[pick])])
        return pa.ListArray.from_arrays(pa.array(word_ends[first], pa.int32()), pa.array(tokens, pa.int32()))

    return coded


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _decoder(tokenizer: Tokenizer):
    spelling = {i: bytes([b]) for b, i in enumerate(BYTE_IDS)}
    spelling[UNKNOWN_ID] = b""
    for m in tokenizer.merges:
        spelling.setdefault(m.new_id, spelling[m.left] + spelling[m.right])
    spelled = [spelling.get(i, b"") for i in range(max(spelling) + 1)]
    shared = SparkSession.active().sparkContext.broadcast(spelled)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        sizes = np.fromiter(map(len, shared.value), np.int64, len(shared.value))
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(sizes)):
            raise ValueError("an id is outside the vocabulary")
        starts = np.cumsum(sizes) - sizes
        letters = np.frombuffer(b"".join(shared.value), np.uint8)
        text = letters[take_runs(starts[ids], sizes[ids])].tobytes()
        token_ends = np.concatenate([[0], np.cumsum(sizes[ids])])
        row_ends = token_ends[np.concatenate([[0], np.cumsum(_sizes(rows))])]
        gone = rows.is_null().to_pylist()
        return pa.array(
            [None if no else text[a:b].decode("utf-8", "replace") for no, a, b in zip(gone, row_ends, row_ends[1:])],
            pa.string(),
        )

    return decode


def choose_dtype(vocab_size: int, requested: str | None = None) -> str:
    """Token width of the binary form; a requested width must hold every id."""
    limits = {"uint16": (1 << 16) - 1, "uint32": (1 << 32) - 1}
    dtype = requested or ("uint16" if vocab_size <= limits["uint16"] else "uint32")
    if dtype not in limits:
        raise ValueError(f"unknown token dtype: {dtype}")
    if vocab_size - 1 > limits[dtype]:
        raise ValueError(f"a vocabulary of {vocab_size} does not fit {dtype}")
    return dtype
