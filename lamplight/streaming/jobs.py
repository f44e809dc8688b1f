"""Structured Streaming: folder ingest and trace windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lamplight.functions.providers import Embedder
from lamplight.plans import ingest, traces
from lamplight.sources.warehouse import Warehouse


def file_stream(spark: SparkSession, folder: str, pattern: str, per_batch: int = 1000) -> DataFrame:
    """New files of a landing folder, whole, a bounded number per batch."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_batch)
        .load(folder)
    )


def ingest_stream(
    store: Warehouse,
    docs: DataFrame,
    items: Column,
    embedder: Embedder,
    extractor: str,
    checkpoint: str,
    now: Callable[[], Column] = F.current_timestamp,
) -> StreamingQuery:
    """Feeds every batch through the batch ingest.

    The ingest replaces by report, so a batch that is replayed after a failure
    leaves the same tables.
    """

    def one_batch(batch: DataFrame, _: int) -> None:
        ingest.ingest_documents(store, batch, items, embedder, extractor, now())

    return (
        docs.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def trace_windows(events: DataFrame, at: str, width: str, delay: str, key: str) -> DataFrame:
    """Closed windows of a trace stream; later rows than ``delay`` are dropped."""
    return traces.windowed(events.withWatermark(at, delay), at, width, key)


def to_files(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
