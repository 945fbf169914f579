"""Structured Streaming ingestion: arriving files, change detection and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType


def arriving_json(spark: SparkSession, folder: str, schema: StructType, most_files: int = 1000) -> DataFrame:
    """T4: files of an inbox; the checkpoint is the state of what was processed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).json(folder).withColumn("file", F.col("_metadata.file_path"))


def changed_only(stream: DataFrame, key: str, fingerprint: str, ts: str | None = None, keep: str = "14 days") -> DataFrame:
    """T5: each (key, fingerprint) passes once. With an event time the state is dropped after `keep`."""
    if ts is None:
        return stream.dropDuplicates([key, fingerprint])
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key, fingerprint])


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch to the sink once everything before it is committed; a failed batch is offered again.

    Offsets advance only after the sink returns, so a sink that upserts by key gives exactly-once results.
    """
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Counters of the batches so far."""

    def __init__(self) -> None:
        self.batches, self.rows, self.failed = 0, 0, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed = event.exception


def due_retries(queue: DataFrame, now, most: int = 6) -> DataFrame:
    """The next retries that are due, oldest first."""
    return queue.where(F.col("next_retry_at") <= now).orderBy("next_retry_at", "job_id").limit(most)
