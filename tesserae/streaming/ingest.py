"""Streams of facts: each micro-batch is one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesserae.database import Database


def ingest(db: Database, stream: DataFrame, checkpoint: str, now: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts writing a streaming DataFrame in the ingest schema to the database.

    A batch's number is committed with its facts, under the name of the checkpoint; a batch that is run again after a failure is skipped, so each is written once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            db.transact(rows, now, (checkpoint.rstrip("/"), number))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
