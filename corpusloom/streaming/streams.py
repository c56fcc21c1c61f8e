"""Structured Streaming forms of incremental work: new files, changed pages, request windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.index import apply_versions
from ..sources.store import Library

MARKDOWN = "path string, text string"


def new_documents(spark: SparkSession, folder: str, schema: str = MARKDOWN, files_per_trigger: int = 1000) -> DataFrame:
    """Rows of Parquet files as they arrive; the checkpoint knows which were taken."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def indexed(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True):  # noqa: ANN201
    """Applies a batch transform to every micro-batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changed_pages(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(url, content_hash, crawled_at): versions of pages not met within the delay."""
    return stream.withWatermark("crawled_at", delay).dropDuplicatesWithinWatermark(["url", "content_hash"])


def followed(stream: DataFrame, library: Library, checkpoint: str, available_now: bool = True, **options: object):  # noqa: ANN201
    """Keeps a built library at the newest versions of a stream (doc_id, file_name, source_url, text, removed, at).

    Each micro-batch is applied as a whole; one that is run again finds nothing to change.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_versions(library, batch.persist(), **options)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    """With a watermark on ts, which may come without a time zone."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def request_windows(stream: DataFrame, size: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Requests per window and event type, with late rows up to the delay."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(stream, delay).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def request_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return _timed(stream, delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
