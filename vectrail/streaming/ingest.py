"""Incremental ingestion: a stream of documents into a store, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import ingest_documents
from ..schemas import Collection
from ..sources.store import Store


def write_batch(store: Store, docs: DataFrame, collection: Collection, **options) -> None:
    """One batch: documents that the store has are skipped, so a repeated batch adds nothing."""
    ingest_documents(store, docs, collection, **options)
    for table in ("documents", "chunks", "embeddings", "audit_logs", "document_states"):
        store.tidy(table)


def start(stream: DataFrame, store: Store, collection: Collection, checkpoint: str, available_now: bool = False, interval: str = "500 milliseconds", **options) -> StreamingQuery:
    """Run ``write_batch`` for each micro-batch; the checkpoint and the contents' hashes make restarts safe."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: write_batch(store, batch, collection, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums of events by window and type, with a watermark where the input is a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = rows.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), kind, "n", "total")
