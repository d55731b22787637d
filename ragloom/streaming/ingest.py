"""Streaming ingestion: documents to embedded chunks, by micro-batches with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..options import ChunkOptions, EmbedOptions
from ..plans.rag import ingest
from ..providers import Provider


def ingest_stream(docs: DataFrame, provider: Provider, path: str, checkpoint: str, chunking: ChunkOptions = ChunkOptions(), embedding: EmbedOptions = EmbedOptions()) -> StreamingQuery:
    """Writes each micro-batch to its own folder under path, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ingest(batch, provider, chunking, embedding).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
