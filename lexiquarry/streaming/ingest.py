"""Documents that arrive as a stream go into an index, a segment a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import Index


def ingest(docs: DataFrame, index: Index, checkpoint: str, name: str = "ingest", segments: int = 16, **trigger) -> StreamingQuery:
    """Upsert every micro-batch of a stream of documents.

    The manifest holds the number of the stream's last batch, so a batch that
    Spark sends again after a failure is added once.  Where there are more
    than ``segments`` segments, neighbouring ones are merged after the batch,
    so that a long stream doesn't make reading slow.  ``trigger`` is that of
    writeStream, by default availableNow.
    """

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            index.upsert(batch, (name, number))
            index.compact(segments)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
