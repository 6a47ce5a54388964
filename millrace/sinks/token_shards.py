"""Token shards as a partitioned table and as flat binary files.

The binary form of shard 7 is ``00007.tokens`` (little-endian ids), ``00007.index`` (uint64
document ends, starting with 0), for supervised data ``00007.labels`` (int32), and
``00007.meta.json``. Readers fetch byte ranges, so one shard is read by many tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.merging import take_runs
from millrace.operators.windows import supervised_places
from millrace.session import materialise
from millrace.sinks.outputs import clear, require_free, save_mode
from millrace.sources.paths import exists, metadata_name, qualified, write_file
from millrace.sources.stores import folder_files, open_store, opened_parquet, row_groups

# Element types of the binary files.
TOKEN_TYPES = {"uint16": "<u2", "uint32": "<u4"}
LABEL_TYPES = {"int32": "<i4"}
INDEX_TYPE = "<u8"
META_SUFFIX = ".meta.json"
DATASET_META = "dataset.meta.json"
STAGING = "_staging"
PLACES = "_supervised"
PLACES_BLOCK = 1 << 16  # labels packed at once

METAS_PER_TASK = 1024
READ_TOKENS = 16_000_000  # tokens read by one task
NEAR_BYTES = 1 << 16  # between two windows that one read fetches
MOST_BYTES = 8 << 20  # of such a read
SPAN_TOKENS = 1 << 20  # tokens fetched by one read
GROUP_BYTES = 8 << 20  # of a row group of a token table
TASK_TOKENS = 100_000_000  # tokens written by one task, about one full shard


def shard_root(spark: SparkSession, path: str) -> str:
    """One spelling for the driver's checks, the writing tasks and the reading tasks."""
    root = qualified(spark, path)
    open_store(root)
    return root


def write_token_table(tokens: DataFrame, path: str, overwrite: bool = False) -> None:
    """(ord, ids[, labels], shard_id) partitioned by shard, in order, with ``tok_start``, and the index of its row groups.

    Each shard is moved to one task and placed there, once, so that readers need not move any tokens. Row groups are
    small, so that a window is read without much around it.
    """
    spark = tokens.sparkSession
    require_free(spark, path, overwrite)
    before = Window.partitionBy("shard_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("ids").cast("bigint")).over(before), F.lit(0).cast("bigint"))
    placed = tokens.withColumn("tok_start", start)
    placed.write.mode(save_mode(overwrite)).option("parquet.block.size", GROUP_BYTES).partitionBy("shard_id").parquet(path)
    root = shard_root(spark, path)
    files = [f"{root}/{name}" for name in folder_files(root, recursive=True) if not any(part.startswith(("_", ".")) for part in name.split("/"))]
    shard = F.regexp_extract("file", r"/shard_id=(\d+)/[^/]*$", 1).cast("int")
    groups = row_groups(spark, files, "tok_start").select(shard.alias("shard_id"), "file", "row_group", "num_rows", F.col("least").alias("tok_start"))
    groups.write.mode("overwrite").parquet(f"{path}/_groups")
    if "labels" in tokens.columns:
        _write_places(spark.read.parquet(path).withColumn("shard_id", F.col("shard_id").cast("int")), path)


def _write_places(rows: DataFrame, path: str) -> None:
    """Where the supervised tokens of (shard_id, tok_start, labels) are, as a table beside them."""
    supervised_places(rows.withColumn("source", F.lit(""))).drop("source").write.mode("overwrite").parquet(f"{path}/{PLACES}")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, slot, mask, next) of a labelled dataset; of one that another writer made from its labels."""
    if exists(spark, f"{path}/{PLACES}"):
        return spark.read.parquet(f"{path}/{PLACES}")
    return supervised_places(_label_blocks(read_shard_metas(spark, path)))


def _label_blocks(metas: DataFrame) -> DataFrame:
    blocks = read_binary_blocks(metas, "", PLACES_BLOCK, labelled=True)
    return blocks.select("source", "shard_id", (F.col("block_id") * PLACES_BLOCK).alias("tok_start"), "labels")


def write_table_meta(spark: SparkSession, path: str, manifest: DataFrame, dtype: str, vocab_size: int, tokenizer: str | None = None) -> None:
    """The facts of a token table beside it: its shards as a table and one row about all of it."""
    manifest.write.mode("overwrite").parquet(f"{path}/_shards")
    facts = {"dtype": dtype, "tokenizer_vocab_size": vocab_size, "tokenizer": tokenizer}
    write_file(spark, f"{path}/_{DATASET_META}", json.dumps(facts, indent=2), overwrite=True)


def is_token_table(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_{DATASET_META}")


def read_token_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, tokens) of a token table: (shard_id, num_tokens, num_docs) and (shard_id, ord, tok_start, ids[, labels]).

    Shards are partitions, so a filter on shard_id reads only their files; places are stored, so one on tok_start
    reads only the row groups it meets.
    """
    manifest = read_table_manifest(spark, path)
    tokens = spark.read.parquet(path)
    return manifest, tokens.withColumn("shard_id", F.col("shard_id").cast("int"))


def read_table_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a token table, whose folders are not listed for it."""
    if not is_token_table(spark, path):
        raise FileNotFoundError(f"token dataset not found: {path}")
    return spark.read.parquet(f"{path}/_shards")


def read_table_groups(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, starts, groups): a token table's shards with the first token of each row group, in order, and where it is."""
    stored = spark.read.parquet(f"{path}/_groups")
    ordered = F.array_sort(F.collect_list(F.struct("tok_start", "file", "row_group")))
    # A shard has a bounded number of tokens, and so of groups.
    listed = stored.groupBy("shard_id").agg(ordered.alias("g"))
    place = F.transform("g", lambda g: F.struct(g["file"].alias("file"), g["row_group"].alias("row_group")))
    return listed.select("shard_id", F.transform("g", lambda g: g["tok_start"]).alias("starts"), place.alias("groups"))


def read_table_windows(plan: DataFrame, groups: DataFrame, seq_len: int, targets: str = "ids") -> DataFrame:
    """Add (x, y) to planned windows (worker, draw, seed, attempt, source, shard_id, start) by reading just their row groups.

    ``groups`` has the columns of ``read_table_groups`` and source. Windows are dealt by the group they start in and a task
    goes through its groups in order, so a group is read by one task, however many windows start in it, and again
    only by a window that comes from the group before.
    """
    named = ["worker", "draw", "seed", "attempt", "source", "shard_id", "start"]
    located = plan.select(*named).join(groups, ["source", "shard_id"])
    only = F.size("starts") == 1  # most shards of small limits; spares their windows two passes over a list
    first = F.when(only, 1).otherwise(F.size(F.filter("starts", lambda s: s <= F.col("start"))))
    past = F.when(only, 1).otherwise(F.size(F.filter("starts", lambda s: s <= F.col("start") + seq_len)))
    located = located.withColumn("_first", first).withColumn("_past", past).select(
        *named, "_first", F.slice("starts", F.col("_first"), F.col("_past") - F.col("_first") + 1).alias("_starts"),
        F.slice("groups", F.col("_first"), F.col("_past") - F.col("_first") + 1).alias("_groups"))
    dealt = located.repartition("source", "shard_id", "_first").sortWithinPartitions("source", "shard_id", "start")
    arrays = list(dict.fromkeys(["ids", targets]))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}

        def read(group: tuple[str, int], wanted: list[tuple[str, int]]) -> list[np.ndarray]:
            if group not in held:
                for other in [g for g in held if g not in wanted]:
                    del held[other]
                with opened_parquet(group[0]) as file:
                    table = file.read_row_group(group[1], columns=arrays)
                held[group] = [pc.list_flatten(table[a]).combine_chunks().to_numpy().astype(np.int32) for a in arrays]
            return held[group]

        for batch in batches:
            start = batch.column("start").to_numpy()
            listed = _runs([batch.column(c) for c in ("_starts", "_groups")])
            x, y = np.empty((len(start), seq_len), np.int32), np.empty((len(start), seq_len), np.int32)
            for a, b in zip(listed, listed[1:]):  # windows of the same groups
                wanted = [(g["file"], g["row_group"]) for g in batch.column("_groups")[a].as_py()]
                at = start[a:b] - batch.column("_starts")[a][0].as_py()
                parts = [read(g, wanted) for g in wanted]
                run = [np.concatenate([p[i] for p in parts]) if len(parts) > 1 else parts[0][i] for i in range(len(arrays))]
                if at.max() + 1 + seq_len > len(run[-1]):
                    raise ValueError(f"{wanted[0][0]} ends before token {start[a + at.argmax()] + seq_len + 1}")
                x[a:b], y[a:b] = _slices(run[0], at, seq_len), _slices(run[-1], at + 1, seq_len)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in named], _lists(x), _lists(y)], [*named, "x", "y"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in located.select(*named).schema)
    return dealt.mapInArrow(fetch, f"{schema}, x array<int>, y array<int>")


def _runs(columns: list[pa.Array]) -> list[int]:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    if n == 0:
        return [0]
    coded = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in map(_spelled, columns)]
    return [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in coded], axis=0)) + 1).tolist(), n]


def _spelled(column: pa.Array) -> pa.Array:
    """Values that Arrow can number: a list is told by its length and its first element, which is enough for groups in order."""
    if not pa.types.is_list(column.type):
        return column
    head = pc.list_element(column, 0)
    if pa.types.is_struct(head.type):
        head = pc.binary_join_element_wise(*[pc.cast(pc.struct_field(head, i), pa.string()) for i in range(head.type.num_fields)], "/")
    return pc.binary_join_element_wise(pc.cast(head, pa.string()), pc.cast(pc.list_value_length(column), pa.string()), "/")


def _slices(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` values for each place."""
    return values[at[:, None] + np.arange(size)]


def _lists(rows: np.ndarray) -> pa.ListArray:
    edges = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(rows.reshape(-1)))


class _ShardFiles:
    """The files of one shard as one attempt writes them, in the staging folder and under a name of its own."""

    def __init__(self, root: str, shard_id: int, dtype: str, labelled: bool, vocab_size: int):
        self.fs, base = open_store(root)
        self.name, self.dtype, self.vocab_size = f"{shard_id:05d}", dtype, vocab_size
        self.kinds = ["tokens", "index", *(["labels"] if labelled else [])]
        self.mark = uuid.uuid4().hex
        self.staged = {k: f"{base}/{STAGING}/{self.name}.{k}.{self.mark}" for k in [*self.kinds, "meta.json"]}
        self.out = {k: self.fs.open_output_stream(self.staged[k]) for k in self.kinds}
        self.out["index"].write(np.zeros(1, INDEX_TYPE).tobytes())
        self.tokens = self.docs = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None) -> None:
        self.out["tokens"].write(ids.astype(TOKEN_TYPES[self.dtype]).tobytes())
        if labels is not None:
            self.out["labels"].write(labels.astype(LABEL_TYPES["int32"]).tobytes())
        self.out["index"].write((self.tokens + np.cumsum(sizes)).astype(INDEX_TYPE).tobytes())
        self.tokens += len(ids)
        self.docs += len(sizes)

    def close(self) -> tuple[str, int, int]:
        for stream in self.out.values():
            stream.close()
        meta = {
            "format": "token-shard", "version": 1, "dtype": self.dtype,
            **({"label_dtype": "int32"} if "labels" in self.kinds else {}),
            "num_tokens": self.tokens, "num_docs": self.docs, "tokenizer_vocab_size": self.vocab_size,
            "files": {k: f"{self.name}.{k}" for k in self.kinds},
        }
        with self.fs.open_output_stream(self.staged["meta.json"]) as out:
            out.write(json.dumps(meta, indent=2).encode())
        return self.mark, self.tokens, self.docs


def publish_shard(root: str, shard_id: int, mark: str, labelled: bool) -> None:
    """Move the files of the attempt ``mark`` to their names, the meta file last. It can be done again, also at the same time."""
    fs, base = open_store(root)
    for kind in ["tokens", "index", *(["labels"] if labelled else []), "meta.json"]:
        staged, final = f"{base}/{STAGING}/{shard_id:05d}.{kind}.{mark}", f"{base}/{shard_id:05d}.{kind}"
        try:
            fs.move(staged, final)
        except OSError:
            # Another attempt of this step has moved it; if not, there is nothing at the final name.
            if fs.get_file_info(final).type != pafs.FileType.File:
                raise


def write_binary_shards(
    tokens: DataFrame, manifest: DataFrame, path: str, dtype: str, vocab_size: int, overwrite: bool = False, tokenizer: str | None = None
) -> DataFrame:
    """Write (shard_id, ord, ids[, labels]) as binary shards; returns (shard_id, num_tokens, num_docs).

    A shard is one task's work by the format, a bounded one (its token limit), and streams
    through it in Arrow batches. ``manifest`` (shard_id, num_tokens) sets the number of tasks. Tasks write to a staging folder and
    report what they wrote; Spark keeps the report of one attempt of each task, and only files named there are published. So an attempt
    that is repeated, or runs beside another, never touches a published file, and a reader sees whole shards only.
    """
    spark = tokens.sparkSession
    clear(spark, path, overwrite)
    path = shard_root(spark, path)
    fs, base = open_store(path)
    fs.create_dir(f"{base}/{STAGING}", recursive=True)
    labelled = "labels" in tokens.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: _ShardFiles | None = None
        current = -1
        done: list[tuple[int, str, int, int]] = []
        for batch in batches:
            shard = batch.column("shard_id").to_numpy()
            edges = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)]):
                if a == b:
                    continue
                if shard[a] != current:
                    if files is not None:
                        done.append((current, *files.close()))
                    current = int(shard[a])
                    files = _ShardFiles(path, current, dtype, labelled, vocab_size)
                lists = batch.column("ids").slice(a, b - a)
                labels = batch.column("labels").slice(a, b - a).flatten().to_numpy() if labelled else None
                sizes = lists.value_lengths().to_numpy()
                files.add(lists.flatten().to_numpy(), sizes, labels)
        if files is not None:
            done.append((current, *files.close()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            names=["shard_id", "mark", "num_tokens", "num_docs"],
        )

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard_id, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                publish_shard(path, shard_id, mark, labelled)
            yield batch.select([0])

    columns = ["shard_id", "ord", "ids", *(["labels"] if labelled else [])]
    size = manifest.agg(F.count("*").alias("shards"), F.sum("num_tokens").alias("tokens")).first()
    tasks = max(1, min(size.shards, max(-(-(size.tokens or 0) // TASK_TOKENS), spark.sparkContext.defaultParallelism)))
    by_shard = tokens.select(*columns).repartition(tasks, "shard_id").sortWithinPartitions("shard_id", "ord")
    written = materialise(by_shard.mapInArrow(write, "shard_id int, mark string, num_tokens bigint, num_docs bigint"), "shard-commits")
    if written.isEmpty():
        written = spark.createDataFrame([(0, *_ShardFiles(path, 0, dtype, labelled, vocab_size).close())], written.schema)
    written.select("shard_id", "mark").mapInArrow(publish, "shard_id int").agg(F.count("*")).collect()
    fs.delete_dir(f"{base}/{STAGING}")  # with what attempts left that did not count
    written = written.select("shard_id", "num_tokens", "num_docs")
    if labelled:
        _write_places(_label_blocks(read_shard_metas(spark, path)), path)
    _write_dataset_meta(tokens, written, path, dtype, vocab_size, tokenizer)
    return written


def _write_dataset_meta(tokens: DataFrame, written: DataFrame, path: str, dtype: str, vocab_size: int, tokenizer: str | None) -> None:
    fs, base = open_store(path)
    total = written.agg(F.count("*").alias("shards"), F.sum("num_tokens").alias("tokens"), F.sum("num_docs").alias("docs")).first()
    meta = {
        "format": "token-dataset", "version": 1, "num_shards": total.shards, "num_tokens": total.tokens,
        "num_docs": total.docs, "dtype": dtype, "tokenizer_vocab_size": vocab_size, **({"tokenizer": tokenizer} if tokenizer else {}),
    }
    if "labels" in tokens.columns:
        counted = tokens.select(F.sum(F.expr("size(filter(labels, v -> v <> -100))")).alias("n")).first()
        meta["supervised_tokens"] = counted.n or 0
    with fs.open_output_stream(f"{base}/{DATASET_META}") as out:
        out.write(json.dumps(meta, indent=2).encode())


def read_shard_metas(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, tokens, labels, dtype, label_dtype, num_tokens, num_docs); the id is the number in the meta file's name.

    File names default to the name of the meta file. A missing path, a path without shards, a meta file that cannot
    be read or lacks its type or counts, or an unknown element type raises.
    """
    path = shard_root(spark, path)
    if not exists(spark, path):
        raise FileNotFoundError(f"token dataset not found: {path}")
    names = [n for n in folder_files(path) if n.endswith(META_SUFFIX) and n != DATASET_META]
    if not names:
        raise FileNotFoundError(f"no *{META_SUFFIX} files in {path}")
    # Names of other writers may have no number; they are counted off in order.
    own = {n: int(n.removesuffix(META_SUFFIX)) for n in names if n.removesuffix(META_SUFFIX).isdigit()}
    ids = own if len(own) == len(names) and len(set(own.values())) == len(names) else {n: i for i, n in enumerate(names)}
    schema = (
        "dtype string, label_dtype string, num_tokens bigint, num_docs bigint,"
        " files struct<tokens: string, labels: string, index: string>"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(path)
        for batch in batches:
            values = []
            for name in batch.column("name").to_pylist():
                with store.open_input_file(f"{base}/{name}") as file:
                    values.append(file.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("shard_id"), batch.column("meta"), pa.array(values, pa.string())], ["shard_id", "meta", "value"])

    listed = spark.createDataFrame([(i, n, metadata_name(n)) for n, i in ids.items()], "shard_id int, name string, meta string")
    raw = listed.repartition(-(-len(names) // METAS_PER_TASK)).mapInArrow(read, "shard_id int, meta string, value string")
    metas = raw.select("shard_id", "meta", F.from_json("value", schema).alias("m"))
    stem = F.regexp_replace("meta", r"\.meta\.json$", "")
    metas = metas.select(
        "shard_id",
        *[F.concat(F.lit(f"{path}/"), F.coalesce(F.col(f"m.files.{k}"), F.concat(stem, F.lit(f".{k}")))).alias(k) for k in ("tokens", "labels")],
        "m.dtype", F.coalesce("m.label_dtype", F.lit("int32")).alias("label_dtype"), "m.num_tokens", "m.num_docs",
    )
    metas = materialise(metas, "shard-metas")  # read once, however many checks and readers follow
    broken = metas.where(F.col("dtype").isNull() | F.col("num_tokens").isNull() | (F.col("num_tokens") < 0)).select("tokens").first()
    if broken is not None:
        raise ValueError(f"the meta file beside {broken[0]} cannot be read, or has no dtype or num_tokens")
    for column, known in (("dtype", TOKEN_TYPES), ("label_dtype", LABEL_TYPES)):
        odd = metas.where(~F.col(column).isin(*known)).select(column).first()
        if odd is not None:
            raise ValueError(f"unsupported {column}: {odd[0]}")
    return metas


def _read_range(path: str, element: np.dtype, expected: int, start: int, count: int) -> np.ndarray:
    fs, path = open_store(path)
    with fs.open_input_file(path) as file:
        if file.size() != expected * element.itemsize:
            raise ValueError(f"{path} does not hold {expected} tokens")
        return np.frombuffer(file.read_at(count * element.itemsize, start * element.itemsize), element)


def read_windows(plan: DataFrame, metas: DataFrame, seq_len: int, targets: str = "ids") -> DataFrame:
    """Add (x, y) to planned windows (worker, draw, seed, attempt, source, shard_id, start) by reading just their bytes.

    ``metas`` has the columns of ``read_shard_metas`` and source. Windows are dealt by shard and span, so a
    task reads on from one place, and what is read grows with the windows and not with the data.
    """
    arrays = ["tokens", "labels"] if targets == "labels" else ["tokens"]
    files = metas.select("source", "shard_id", F.col("num_tokens").alias("_size"), "dtype", "label_dtype", *[F.col(a).alias(f"_{a}") for a in arrays])
    span = F.floor(F.col("start") / SPAN_TOKENS)
    named = ["worker", "draw", "seed", "attempt", "source", "shard_id", "start"]
    located = plan.select(*named).join(files, ["source", "shard_id"]).withColumn("_span", span)
    dealt = located.repartition("source", "shard_id", "_span").sortWithinPartitions("source", "shard_id", "start")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pafs.NativeFile] = {}

        def read(path: str, element: np.dtype, size: int, starts: np.ndarray) -> np.ndarray:
            """The windows at rising places of a file; those near each other by one read."""
            if path not in opened:
                if len(opened) == len(arrays):  # rows come by shard, so an earlier one is done
                    for file in opened.values():
                        file.close()
                    opened.clear()
                fs, inner = open_store(path)
                opened[path] = fs.open_input_file(inner)
                if opened[path].size() != size * element.itemsize:
                    raise ValueError(f"{path} does not hold {size} tokens")
            found = np.empty((len(starts), seq_len), np.int32)
            gaps = np.flatnonzero((np.diff(starts) - seq_len) * element.itemsize > NEAR_BYTES) + 1
            most = max(1, MOST_BYTES // element.itemsize)
            edges = np.unique(np.concatenate([[0], gaps, np.flatnonzero(np.diff((starts - starts[0]) // most)) + 1, [len(starts)]]))
            for a, b in zip(edges, edges[1:]):
                low, high = int(starts[a]), int(starts[b - 1]) + seq_len
                values = np.frombuffer(opened[path].read_at((high - low) * element.itemsize, low * element.itemsize), element)
                found[a:b] = _slices(values, starts[a:b] - low, seq_len)
            return found

        for batch in batches:
            start = batch.column("start").to_numpy()
            x, y = np.empty((len(start), seq_len), np.int32), np.empty((len(start), seq_len), np.int32)
            edges = _runs([batch.column("_tokens")])
            for a, b in zip(edges, edges[1:]):  # windows of one shard
                row = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c not in named}
                tokens = np.dtype(TOKEN_TYPES[row["dtype"]])
                order = np.argsort(start[a:b], kind="stable")  # a task may hold two spans of a shard
                back = np.argsort(order, kind="stable")
                at = start[a:b][order]
                x[a:b] = read(row["_tokens"], tokens, row["_size"], at)[back]
                if targets == "labels":
                    y[a:b] = read(row["_labels"], np.dtype(LABEL_TYPES[row["label_dtype"]]), row["_size"], at + 1)[back]
                else:
                    y[a:b] = read(row["_tokens"], tokens, row["_size"], at + 1)[back]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in named], _lists(x), _lists(y)], [*named, "x", "y"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in located.select(*named).schema)
    return dealt.mapInArrow(fetch, f"{schema}, x array<int>, y array<int>")


def read_binary_blocks(metas: DataFrame, source: str, block_size: int, overlap: int = 0, labelled: bool = False) -> DataFrame:
    """(source, shard_id, block_id, ids[, labels]) by reading byte ranges; a wrong file length raises.

    A block goes on into the next ones by ``overlap`` tokens.
    """
    spark = metas.sparkSession
    arrays = ["tokens", "labels"] if labelled else ["tokens"]

    span = max(1, SPAN_TOKENS // block_size)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["span"] * span * block_size
                count = min(span * block_size + overlap, row["num_tokens"] - start)
                starts = np.arange(0, min(span * block_size, count), block_size)
                sizes = np.minimum(block_size + overlap, count - starts)
                edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns = []
                for kind in arrays:
                    element = np.dtype(TOKEN_TYPES[row["dtype"]] if kind == "tokens" else LABEL_TYPES[row["label_dtype"]])
                    values = _read_range(row[kind], element, row["num_tokens"], start, count)
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(values.astype(np.int32)[take_runs(starts, sizes)])))
                blocks = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(blocks, row["shard_id"], np.int32)),
                        pa.array(row["span"] * span + np.arange(blocks, dtype=np.int64)),
                        *columns,
                    ],
                    names=["shard_id", "block_id", "ids", "labels"][: 2 + len(arrays)],
                )

    last = F.floor((F.col("num_tokens") - 1) / (span * block_size))
    spans = metas.where("num_tokens > 0").withColumn("span", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    schema = "shard_id int, block_id bigint, ids array<int>" + (", labels array<int>" if labelled else "")
    # The rows are few and small, whatever they stand for, so the number of tasks is told and not left to their size.
    size = spans.agg(F.count("*").alias("spans"), F.sum(F.least("num_tokens", F.lit(span * block_size))).alias("tokens")).first()
    tasks = max(1, min(size.spans, max(spark.sparkContext.defaultParallelism, -(-(size.tokens or 0) // READ_TOKENS))))
    return spans.repartition(tasks, "shard_id", "span").mapInArrow(fetch, schema).withColumn("source", F.lit(source))
