"""Endless draws from a mixture as a stream that resumes by its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.windows import MixtureSource, draw_sources


def stream_draws(spark: SparkSession, sources: list[MixtureSource], per_batch: int, seed: int, workers: int = 1) -> DataFrame:
    """(worker, draw, seed, source) without end, ``per_batch`` numbers a batch.

    The stream's offset is the number of the next draw, so a stopped run goes on exactly there, and any number of
    batches are the same rows as one call of ``source_draws``.
    """
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).load()
    return draw_sources(numbers.select(F.col("value").alias("draw")), sources, seed, workers)


def write_draws(draws: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, endless: bool = False) -> StreamingQuery:
    """Write ``make(draws)`` of each batch below ``path``, in a folder with its number, which a repeated batch replaces.

    ``make`` turns draws into what is wanted of them, such as windows. One batch is made, or batches until the query is stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch-{number:09d}")

    writer = draws.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer if endless else writer.trigger(availableNow=True)).start()
