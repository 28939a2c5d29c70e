"""Commits from a stream: every micro-batch of changes becomes one commit.

The number of the last batch is kept with the ref that its commit moved, so a
batch that is run again after a failure is recorded once. Only the changes of a
batch are passed on, and only regions with a change get new nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.engine import Engine
from palimpsest.functions.coords import KEY


def commit_stream(engine: Engine, changes: DataFrame, checkpoint: str, start_ms: int = 0) -> StreamingQuery:
    """Start committing (key, payload, hash) changes, of which a null hash removes a chunk; the last of a key wins by ``seq``."""

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        last = batch.groupBy(*KEY).agg(F.max_by(F.struct("payload", "hash"), "seq").alias("_last")).select(*KEY, "_last.*")
        engine.commit_changes(last, start_ms + number, (str(checkpoint), number))

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
