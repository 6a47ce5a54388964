"""Incremental ingest: file streams to encoded rows in a Parquet table, or to ChatML rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.text import not_blank
from millrace.operators.bpe_codec import Tokenizer
from millrace.operators.chat import convert_chat
from millrace.sinks.outputs import write_chat_jsonl
from millrace.sources.paths import file_of_row
from millrace.sources.readers import number_lines, parse_objects


def stream_parquet(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder or a pattern as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def encode_stream(documents: DataFrame, tokenizer: Tokenizer, *keys: str) -> DataFrame:
    """Keys and ids of documents that are not blank; stateless, so no watermark is needed."""
    return documents.where(not_blank(F.col("text"))).select(*keys, tokenizer.encode(F.col("text")).alias("ids"))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """(file, start, line): lines of text files as a stream, with the byte at which a line's split starts."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(file_of_row().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def placed_lines(batch: DataFrame) -> DataFrame:
    """(ord, line) of one batch of ``stream_lines``: lines that are not blank, in the order of file and place."""
    numbered = number_lines(batch).where(not_blank(F.col("line")))
    return numbered.select(F.struct("file", (F.col("start") * 2 + F.col("number")).alias("place")).alias("ord"), "line")


def convert_stream(lines: DataFrame, path: str, checkpoint: str, source_name: str | None = None) -> StreamingQuery:
    """Convert what is there of ``stream_lines`` to ChatML rows below ``path``, one folder for each batch, and stop.

    A batch that was cut off is run again under its number and replaces what it left, so each line is written
    once. Folders by number, and rows in them, are in the order of the files taken up. A malformed line fails its batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        converted = convert_chat(parse_objects(placed_lines(batch)), source_name)
        write_chat_jsonl(converted, f"{path.rstrip('/')}/batch-{number:09d}", overwrite=True)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop. The checkpoint makes the next call take up from here."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
