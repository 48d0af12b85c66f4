"""The process store as a stream: state for each live process that a timer clears.

Events (process_id, structure, created_at, deleted) come in any order within the watermark.  The state of a process
is its last version and when it expires; a put sets a timer for that, a later put moves it, a deletion or the timer clears the state.  What
comes out is a log of changes: ``created``, ``replaced``, ``deleted`` and ``expired``.  State is kept by key in RocksDB on the executors and
checkpointed, and holds live processes only, so it does not grow with the length of the stream.

An event older than the version in state changes nothing; of one instant a deletion is the last.  Deleting what is not
there changes nothing.  Events without an id or a time are left out.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "process_id string, change string, structure string, at timestamp"
#: The state store that keeps timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LiveProcess(StatefulProcessor):
    """The life of one process."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = 1000 * ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: The last version is kept for as long as the process lives; a tombstone as long as a process would.
        self.state = handle.getValueState("process", "structure string, version long, expires_ms long, deleted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        last = max(rows, key=lambda r: (r["version"], bool(r["deleted"]), r["structure"] or ""))
        if held is not None and (held[1], bool(held[3])) >= (last["version"], bool(last["deleted"])):
            return
        live = held is not None and not held[3]
        expires = last["version"] // 1000 + self.ttl_ms
        if held is not None:
            self.handle.deleteTimer(held[2])
        if expires <= timerValues.getCurrentWatermarkInMs():  # came too late to live
            self.state.clear()
            if live:
                yield self._row(key, "expired", held[0], held[2])
            return
        self.state.update((None if last["deleted"] else last["structure"], last["version"], expires, bool(last["deleted"])))
        self.handle.registerTimer(expires)
        if last["deleted"]:
            if live:
                yield self._row(key, "deleted", held[0], last["version"] // 1000)
        else:
            yield self._row(key, "replaced" if live else "created", last["structure"], last["version"] // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        if held is not None and held[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            if not held[3]:
                yield self._row(key, "expired", held[0], held[2])

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, change: str, structure: str | None, ms: int) -> Row:
        return Row(process_id=key[0], change=change, structure=structure, at=datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC))


def live_processes(events: DataFrame, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """``CHANGES`` of a stream of events; the session needs the state store of ``PROVIDER``."""
    events.sparkSession.conf.set(*PROVIDER)
    known = events.where("process_id is not null and created_at is not null").withWatermark("created_at", late)
    rows = known.select("process_id", "structure", "created_at", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.unix_micros("created_at").alias("version"))
    return rows.groupBy("process_id").transformWithState(LiveProcess(ttl_seconds), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
