"""Re-checks as state: each entry's status only rises, and a timer tells when it is to be looked at again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.display import status_of_rank, status_rank
from ..operators.queue import is_legacy

#: State of an entry: rank of its status, whether its shape is a legacy one, the newest check and the newest row's time, in milliseconds (none: null).
STATE = "rank int, legacy boolean, checked long, seen long"
OUTPUT = "id string, rank int, due boolean, at timestamp"
#: Rows of a change: the status rose or a check came in, or a timer fired.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recheck(StatefulProcessor):
    """Keeps an entry's state and one timer, at which its last check is too old."""

    def __init__(self, hours: int, published: int, accepted: int):
        self.wait, self.published, self.accepted = hours * 3_600_000, published, accepted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE)

    def _due(self, rank: int, legacy: bool, checked: int | None, now: int) -> bool:
        if rank >= self.published or (rank == self.accepted and not legacy):
            return False
        return legacy or checked is None or now - checked > self.wait

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rank, legacy, checked, seen = self.entry.get() if self.entry.exists() else (-1, False, None, -1)
        for pdf in rows:  # rows may come late and in any order: maxima, and the shape of the newest row
            rank = max(rank, int(pdf["rank"].max()))
            if pdf["checked"].notna().any():
                checked = max(checked or 0, int(pdf["checked"].max()))
            newest = pdf.sort_values(["seen", "legacy"]).iloc[-1]
            if int(newest["seen"]) >= seen:
                legacy, seen = bool(newest["legacy"]), int(newest["seen"])
        self.entry.update((rank, legacy, checked, seen))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        due = self._due(rank, legacy, checked, now)
        if not due and rank < self.published and rank != self.accepted:
            self.handle.registerTimer(max(checked + self.wait + 1, now + 1))
        yield self._row(key, rank, due, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rank, legacy, checked, _ = self.entry.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield self._row(key, rank, self._due(rank, legacy, checked, now), now)

    def _row(self, key, rank: int, due: bool, at: int) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "rank": pd.array([rank], "Int32"), "due": [due], "at": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def recheck_stream(events: DataFrame, late: str = "1 day", hours: int = 18) -> DataFrame:
    """(id, status, due, at) whenever an entry's rows come in or its re-check falls due, for a stream of (id, status, title, reason, checked, ts).

    status is the highest that the entry has had. due is what is_recheck_due() says of that status, the newest row's title and
    reason and the newest check, at the watermark, or at the timer that fires `hours` after that check. ts is the time of a
    row; those over `late` behind the newest are gone. Needs the RocksDB state store (use_rocksdb()). Rows with a null id or ts
    are left out, rows that repeat change nothing.
    """
    millis = lambda c: F.unix_millis(F.col(c))
    rows = events.where("id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select(
        F.col("id").cast("string").alias("id"), F.coalesce(status_rank(F.col("status")), F.lit(-1)).alias("rank"), is_legacy(F.col("title"), F.col("reason")).alias("legacy"), millis("checked").alias("checked"), millis("ts").alias("seen"), "ts",
    )
    ranks = events.sparkSession.range(1).select(status_rank(F.lit("officially-published")).alias("p"), status_rank(F.lit("accepted")).alias("a")).first()
    out = rows.groupBy("id").transformWithStateInPandas(Recheck(hours, ranks["p"], ranks["a"]), OUTPUT, "Update", "EventTime")
    return out.select("id", status_of_rank(F.col("rank")).alias("status"), "due", "at")


def use_rocksdb(spark) -> None:
    """State with timers needs this store; one of a session's queries that run on another keep it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def latest(changes: DataFrame) -> DataFrame:
    """Of each entry the last change that the stream gave: that of the highest status and, of these, of the latest time; a due entry counts after one that isn't."""
    return changes.groupBy("id").agg(F.max_by(F.struct("status", "due", "at"), F.struct(F.col("at"), status_rank(F.col("status")), F.col("due"))).alias("x")).select("id", "x.*")
