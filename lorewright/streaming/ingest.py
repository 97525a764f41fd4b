"""Incremental ingest: new files of a folder become chunks and vectors as they arrive (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import chunk, vector
from lorewright.sources.files import base_name, is_supported, pdf_text
from lorewright.sources.files import _read as read_files
from lorewright.sources.models import embed_column
from lorewright.sources.stores import VectorStore

BINARY = "path string, modificationTime timestamp, length long, content binary"


def document_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the supported files of a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.filter(is_supported(F.col("path")))


def ingest(spark: SparkSession, folder: str, store: VectorStore, embedder, checkpoint: str, options: chunk.ChunkOptions | None = None, extract=pdf_text):
    """Start the stream. Every micro-batch is cut, embedded and upserted by chunk id; a batch that is run again after a
    failure writes the same rows, so the store ends up the same."""
    o = options or chunk.ChunkOptions()

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        docs = read_files(df, extract, strict=False).select(base_name(F.col("path")).alias("source"), F.col("content").alias("text"))
        cut = chunk.split_by_sentence(docs, "text", "source", o)
        store.add(vector.vector_rows(embed_column(cut, "content", embedder)))

    return document_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, at: str, window: str = "10 minutes", delay: str = "30 minutes", by: str = "event_type") -> DataFrame:
    """Counts per event-time window and key; rows later than ``delay`` are left out once their window is closed."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return events.withWatermark(at, delay).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin_at"), F.col("window.end").alias("end_at"), by, "n")
