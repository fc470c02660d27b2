"""Structured Streaming into a store: every micro-batch is one atomic batch, and a replayed one changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.plans.ordering import bucket_of, range_bounds, with_running_sum
from keystrata.sources.store import Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, order: str, **trigger) -> StreamingQuery:
    """Write a stream of (key, is_put, value and an order column) to store; order decides within a micro-batch."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        try:
            numbered = with_running_sum(b.withColumn("_one", F.lit(1)), "_one", bucket_of(order, range_bounds(b, order)), order, "ordinal")
            store.write_frame(numbered.select("ordinal", "key", "is_put", "value"), stream=(name, batch_id))
        finally:
            b.unpersist()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
