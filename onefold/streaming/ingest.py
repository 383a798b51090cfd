"""Streams of records into a store, a micro-batch at a time.

Every batch makes a version of the store, which also tells which batches it has, and the next batch begins with the latest
version. So a stream that is stopped, or fails, goes on from its checkpoint with all that came before; a batch that is
replayed is passed over, and records that come again in another stream are known by their hashes.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from onefold.operators import store


class Sink:
    """The store below `root`, as the batches of a stream make it."""

    def __init__(self, spark: SparkSession, root: str, origin: str | None = None):
        self.spark, self.root, self.origin = spark, root, origin

    @property
    def state(self) -> store.State:
        return store.load(self.spark, self.root)

    def take(self, stream: str, batch: DataFrame, batch_id: int) -> None:
        state = self.state
        if state.streams.get(stream, -1) < batch_id and not batch.isEmpty():
            state = store.ingest(state, batch, self.origin)
            store.save(replace(state, streams=state.streams | {stream: batch_id}))


def start(records: DataFrame, sink: Sink, checkpoint: str) -> StreamingQuery:
    """A query that takes what there is of a stream of records (model.RECORD) and stops. A stream is known by its checkpoint."""
    return records.writeStream.foreachBatch(lambda batch, batch_id: sink.take(checkpoint, batch, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
