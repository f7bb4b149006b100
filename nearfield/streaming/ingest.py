"""Streams of vector changes into collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.sources.collection import Collection


def start_ingest(changes: DataFrame, spark: SparkSession, root: str, name: str, checkpoint: str, available_now: bool = True, flush_parts: int = 16, compact_segments: int = 8, graph_rows: int = 0) -> StreamingQuery:
    """Apply a stream ``(id, op, vector, at)`` to a collection, one commit a batch.

    Of a batch's changes to one id the one of the greatest ``at`` counts.  The
    commit keeps the number of the batch, so one that is delivered again after a failure
    is passed over.  Pending parts are flushed when there are ``flush_parts`` of them and segments compacted when
    there are ``compact_segments``, with graphs of ``graph_rows`` vectors if that is given, so reads don't grow with the number of batches.
    """

    def apply(batch: DataFrame, number: int) -> None:
        collection = Collection.open(spark, root, name)
        if collection.manifest["streams"].get(checkpoint, -1) >= number:
            return
        last = batch.groupBy("id").agg(F.max_by(F.struct("op", "vector"), "at").alias("last")).select("id", "last.*").persist()
        try:
            collection.change(last.where("op = 'upsert'").select("id", "vector"), last.where("op = 'delete'").select("id"), stream=(checkpoint, number))
        finally:
            last.unpersist()
        shards = lambda rows: -(-rows // graph_rows) if graph_rows else 0
        if len(collection.manifest["pending"]) >= flush_parts:
            collection.flush(shards(collection.pending_rows))
        if len(collection.manifest["segments"]) >= compact_segments:
            collection.compact(shards(collection.gauges()["rows"]))

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
