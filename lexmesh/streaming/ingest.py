"""Documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmesh.operators.fuzzyindex import FuzzyIndex


def ingest(stream: DataFrame, index: FuzzyIndex, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Add each micro-batch of (key, text) to the index. A batch that runs again after a failure adds nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        index.update_many(batch, order=order)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
