"""Audit events of a stream, written once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import audit


def write_events(records: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of (event_type, payload, ...) by batch and kind.

    A batch that is repeated after a failure overwrites its own folders, so no
    event is written twice.
    """
    writer = records.writeStream.foreachBatch(lambda batch, number: audit.write(batch, root, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
