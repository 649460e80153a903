"""Streaming ingest: files as they arrive, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnkit.options import Options
from cairnkit.plans.ingest import records
from cairnkit.plans.store import ChunkStore


def stream_into(docs: DataFrame, store: ChunkStore, zone_id: str, checkpoint: str, record_type: str = "knowledge", options: Options | None = None, embed: Callable[[Column], Column] | None = None, **trigger) -> StreamingQuery:
    """Start a query that turns a stream of docs (source_path, text) into records of a zone.

    chunk_ids follow from content, so that a batch which is replayed after a failure changes
    nothing. trigger is that of writeStream; availableNow by default.
    """
    def upsert(batch: DataFrame, _: int) -> None:
        store.upsert(zone_id, records(batch, zone_id, record_type, options, embed))

    ready = docs.where(F.col("source_path").isNotNull() & F.col("text").isNotNull())
    return ready.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
