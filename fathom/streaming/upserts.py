"""Upserting a stream of documents into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fathom.sources.collection import Collection


def upsert_stream(
    documents: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Merge each micro-batch by key; the highest seq wins, so a repeated batch
    leaves the collection as it is."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        collection.upsert(batch)

    writer = documents.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
