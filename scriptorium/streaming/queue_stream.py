"""The queue as a stream: statuses that only rise, and snapshots updated batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.display import status_of_rank, status_rank


def running_status(events: DataFrame, key: str = "id", status: str = "status") -> DataFrame:
    """The highest status of each key so far: a maximum, so late and repeated events change nothing."""
    return events.groupBy(key).agg(status_of_rank(F.max(status_rank(F.col(status)))).alias(status))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by key and window; windows close `late` after their newest event, so state is bounded."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), key, "count")


def upsert_stream(candidates: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the snapshot that read() gives, and written under its batch number.

    A batch that is run again reads the same snapshot and writes the same folder, so results don't double.
    """

    def one(batch: DataFrame, number: int) -> None:
        write(merge(read(), batch), number)

    return candidates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
