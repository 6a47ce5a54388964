"""Document quotas and the mixed corpus a tokenizer is trained on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.numbers import draw_key
from millrace.operators.cutoffs import hash_bucket, ord_bucket, take_first

SHUFFLED_KINDS = ("parquet", "table")
KINDS = ("local", "jsonl", *SHUFFLED_KINDS)

# Defaults of a tokenizer specification.
DEFAULTS = {"vocab_size": 8192, "max_documents": 100_000, "shuffle_buffer": 10_000, "seed": 42}

# The names that specification files use for the fields of a specification, of a corpus, and for a catalogue table.
FILE_KEYS = {
    "tokenizer_path": "path", "tokenizer_vocab_size": "vocab_size", "tokenizer_train_max_documents": "max_documents",
    "shuffle_buffer_size": "shuffle_buffer",
}
CORPUS_KEYS = {"data_source": "kind", "data_path": "path", "dataset_name": "table", "dataset_split": "split", "shuffle_buffer_size": "shuffle_buffer"}
TABLE_KIND = "hf"


def _renamed(values: dict, names: dict[str, str]) -> dict:
    """With the short names; a field that is given under both fails."""
    twice = [k for k in names if k in values and names[k] in values]
    if twice:
        raise ValueError(f"given twice: {', '.join(twice)}")
    return {names.get(k, k): v for k, v in values.items()}


@dataclass(frozen=True)
class CorpusSpec:
    name: str
    kind: str
    weight: float = 1.0
    path: str | None = None
    table: str | None = None
    split: str = "train"
    text_column: str = "text"
    shuffle_buffer: int | None = None

    @classmethod
    def of(cls, values: dict) -> CorpusSpec:
        """From a mapping, under the names of the fields or those of specification files."""
        given = _renamed({k: v for k, v in values.items() if v is not None}, CORPUS_KEYS)
        config = given.pop("dataset_config", None)  # a part of a catalogue name
        if config and given.get("table"):
            given["table"] = f"{given['table']}.{config}"
        if given.get("kind") == TABLE_KIND:
            given["kind"] = "table"
        return cls(**given)


@dataclass(frozen=True)
class TokenizerSpec:
    corpora: list[CorpusSpec]
    path: str
    vocab_size: int = DEFAULTS["vocab_size"]
    max_documents: int = DEFAULTS["max_documents"]
    shuffle_buffer: int = DEFAULTS["shuffle_buffer"]
    seed: int = DEFAULTS["seed"]

    @classmethod
    def of(cls, values: dict) -> TokenizerSpec:
        """From a mapping with ``raw_datasets`` or, failing that, ``train_datasets``, under the names of the fields or of files."""
        values = _renamed(values, FILE_KEYS)
        corpora = values.get("raw_datasets") or values.get("train_datasets")
        if not corpora:
            raise ValueError("a tokenizer specification needs raw_datasets")
        if values.get("path") is None:
            raise ValueError("a tokenizer specification needs a path")
        unknown = set(values) - {*DEFAULTS, "raw_datasets", "train_datasets", "path"}
        if unknown:
            raise ValueError(f"unknown keys in a tokenizer specification: {', '.join(sorted(unknown))}")
        given = {k: values[k] for k in DEFAULTS if k in values}
        return cls([CorpusSpec.of(c) for c in corpora], values["path"], **given)


def validate_corpora(corpora: list[CorpusSpec]) -> None:
    for c in corpora:
        if c.kind not in KINDS:
            raise ValueError(f"unknown corpus kind: {c.name} uses {c.kind}")
        if c.weight < 0 or sum(d.weight for d in corpora) <= 0:
            raise ValueError(f"bad weight: {c.name}")
        if c.kind == "table" and not c.table:
            raise ValueError(f"a table corpus needs a table name: {c.name}")
        if c.kind != "table" and not c.path:
            raise ValueError(f"a {c.kind} corpus needs a path: {c.name}")


def quotas(spark: SparkSession, corpora: list[CorpusSpec], max_documents: int) -> DataFrame:
    """(src_ord, source, n): documents to take from each source.

    Halves round to even. A local source counts as one document, but its weight dilutes the others.
    """
    rows = [(i, c.name, c.kind, float(c.weight)) for i, c in enumerate(corpora)]
    total = sum(c.weight for c in corpora)
    share = F.bround(F.lit(max_documents) * F.col("weight") / F.lit(total)).cast("bigint")
    specs = spark.createDataFrame(rows, "src_ord int, source string, kind string, weight double")
    return specs.select("src_ord", "source", F.when(F.col("kind") == "local", 1).otherwise(F.greatest(F.lit(1), share)).alias("n"))


def shuffle_key(seed: int, src_ord, ord_col):
    """The place of a document in the seeded shuffle of its source."""
    return draw_key(F.lit(seed) + src_ord, ord_col)


def is_shuffled(corpus: CorpusSpec, default_buffer: int) -> bool:
    buffer = corpus.shuffle_buffer if corpus.shuffle_buffer is not None else default_buffer
    return corpus.kind in SHUFFLED_KINDS and buffer > 0


def mixed_corpus(documents: DataFrame, spec: TokenizerSpec) -> DataFrame:
    """The quota of every source, shuffled sources in seeded order: (src_ord, source, ord, place, text).

    ``documents`` is (source, ord, text). Sorting by (src_ord, place, ord) gives the corpus order.
    """
    validate_corpora(spec.corpora)
    spark = documents.sparkSession
    wanted = quotas(spark, spec.corpora, spec.max_documents)
    shuffled = [c.name for c in spec.corpora if is_shuffled(c, spec.shuffle_buffer)]
    numbered = documents.join(F.broadcast(wanted.select("source", "src_ord")), "source")
    is_drawn, by_ord = F.col("source").isin(shuffled), F.col("ord")
    key = shuffle_key(spec.seed, F.col("src_ord"), by_ord)
    # Within a source all orders have one form: md5 keys, or ordinals of equal width.
    placed = numbered.withColumn("place", F.when(is_drawn, key).otherwise("")).withColumn(
        "_order", F.when(is_drawn, key).otherwise(F.lpad(by_ord.cast("string"), 19, "0"))
    )
    bucket = F.when(is_drawn, hash_bucket(key)).otherwise(ord_bucket(by_ord))
    taken = take_first(placed, "source", "_order", bucket, wanted)
    return taken.select("src_ord", "source", "ord", "place", "text")
