"""Draining a stream into a batch job under an id of its own."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def drain(writer: DataStreamWriter, each: Callable[[DataFrame, str, int], None]) -> None:
    """Run ``each(batch, stream id, epoch)`` for everything that is there now, then stop.

    The stream id is the one that Spark keeps in the checkpoint: a restarted stream has it again, so
    a replayed epoch finds its own rows; another stream, or a fresh checkpoint, has another one."""
    known = threading.Event()
    ids: list[str] = []

    def call(batch: DataFrame, epoch: int) -> None:
        known.wait()
        each(batch, ids[0], int(epoch))

    query = writer.foreachBatch(call).trigger(availableNow=True).start()
    ids.append(query.id)
    known.set()
    query.awaitTermination()
