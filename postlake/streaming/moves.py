"""Moves as keyed state: a message that shows up under another path has moved there.

A stream of sightings (message_id, file_path, seen_at) keeps for each message id the path it was last seen at.  A sighting
under another path is a move and replaces it; one that is older than what is known (late, but within the watermark) changes nothing.
A timer forgets ids that haven't been seen for ``keep``, so the state is of those seen lately, not of all there ever were.
``moves`` is the same over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from postlake.runtime import ship_package

MOVE = "message_id string, old_path string, new_path string, moved_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastPath(StatefulProcessor):
    """The path that each message id was last seen at."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "file_path string, seen_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [(int(t.value // 1_000), p) for batch in rows for t, p in zip(batch["seen_at"], batch["file_path"], strict=True)]
        known = self.last.get() if self.last.exists() else None
        path, at = known if known is not None else (None, -(2**62))
        moves = []
        for t, p in sorted(seen):
            if (t, p) <= (at, path or ""):
                continue
            if path is not None and p != path:
                moves.append((key[0], path, p, pd.Timestamp(t * 1_000)))
            path, at = p, t
        self.last.update((path, at))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at // 1_000 + self.keep_ms)
        if moves:
            yield pd.DataFrame(moves, columns=["message_id", "old_path", "new_path", "moved_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def moves_stream(sightings: DataFrame, lateness: str = "1 hour", keep_days: float = 400) -> DataFrame:
    """The moves (message_id, old_path, new_path, moved_at) of a stream of sightings (message_id, file_path, seen_at).

    Sightings without an id, path or time are left out.  What is later than ``lateness`` is dropped by the watermark.  Of one
    message's sightings at one time the paths go in order.  The state is in RocksDB, which the session is set to use.
    """
    spark = sightings.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = sightings.where("message_id is not null and message_id <> '' and file_path is not null and seen_at is not null").select("message_id", "file_path", "seen_at")
    grouped = known.withWatermark("seen_at", lateness).groupBy("message_id")
    return grouped.transformWithStateInPandas(LastPath(int(keep_days * 86_400_000)), MOVE, "Append", "EventTime")


def moves(sightings: DataFrame) -> DataFrame:
    """The same over a table at once."""
    known = sightings.where("message_id is not null and message_id <> '' and file_path is not null and seen_at is not null").select("message_id", "file_path", "seen_at").distinct()
    w = Window.partitionBy("message_id").orderBy("seen_at", "file_path")
    out = known.withColumn("old_path", F.lag("file_path").over(w)).where(F.col("old_path") != F.col("file_path"))
    return out.select("message_id", "old_path", F.col("file_path").alias("new_path"), F.col("seen_at").alias("moved_at"))
