"""Streams into collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..collection import Collection


def upserts(stream: DataFrame, collection: Collection, seq: str | None = None) -> DataStreamWriter:
    """A writer that puts each micro-batch of a stream (k, doc) into a collection in one commit.

    Putting the same rows again changes nothing, so a batch that Spark repeats
    after a failure leaves the same state.
    """
    return stream.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else collection.put_df(batch, seq))
