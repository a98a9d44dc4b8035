"""What streams remember per key, in Spark's state store: the last version of a file, the last update of an analyser.

A batch touches the keys that it holds and nothing else, so its cost doesn't grow with the stream's age. A key's rows of one batch are
put in order before they are looked at; batches come in order of time. State and output follow the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("completed", "failed", "terminated")
EPOCH = datetime(1970, 1, 1)


def use_state_store(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store. It is a setting of the session, read when a stream starts."""
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def millis(moment: datetime) -> int:
    """Timestamps come without a zone, as the session's, which is UTC here."""
    plain = moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment
    return (plain - EPOCH) // timedelta(milliseconds=1)


class LastVersion(StatefulProcessor):
    """Keeps the last `sha` of a file and yields the rows that change it. `ttl_ms` forgets files that long after their last change."""

    def __init__(self, time: str, ttl_ms: int | None = None):
        self.time, self.ttl_ms = time, ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "sha string", self.ttl_ms) if self.ttl_ms else handle.getValueState("last", "sha string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.exists()
        before = self.last.get()[0] if known else None
        changed = False
        for row in sorted(rows, key=lambda r: (r[self.time] is not None, r[self.time], r["sha"] is not None, r["sha"] or "")):
            if not known or row["sha"] != before:
                known, before, changed = True, row["sha"], True
                yield row
        if changed:
            self.last.update((before,))

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Yields (agent, status, progress, last_update, stalled_at) when an analyser that isn't done was silent for the timeout.

    With `event_time`, the clock is the watermark; else it is the cluster's, and silence alone brings the row. A stall that the same
    batch ends is told too, with `event_time`. Later updates start a new wait.

    A silence longer than the timeout never lies inside a stretch of that length, so of each stretch of time only the first and the
    last update are held: memory follows the time that a batch spans, not its rows.
    """

    def __init__(self, timeout_ms: int, event_time: bool):
        self.timeout_ms, self.event_time = timeout_ms, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, progress double, ts timestamp, event_id long")

    def _stalled(self, agent, update) -> Row:
        status, progress, ts, _ = update
        return Row(agent=agent, status=status, progress=progress, last_update=ts, stalled_at=ts + timedelta(milliseconds=self.timeout_ms))

    def _ends(self, rows) -> Iterator[tuple]:
        """The first and the last update of every stretch, in order; of equal ones that which came first."""
        ends: dict[int, tuple[tuple, tuple]] = {}
        for r in rows:
            update = (r["status"], r["progress"], r["ts"], r["event_id"])
            stretch = millis(update[2]) // max(self.timeout_ms, 1)
            first, last = ends.get(stretch, (update, update))
            ends[stretch] = (update if update[2:] < first[2:] else first, update if update[2:] > last[2:] else last)
        for stretch in sorted(ends):
            yield from ends[stretch]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        timers = list(self.handle.listTimers())
        for update in self._ends(rows):
            if last is not None and (update[2], update[3]) <= (last[2], last[3]):
                continue        # an older one that comes late tells nothing new
            # A gap is told here if its timer has yet to fire, or never was set, as both rows came at once.
            if self.event_time and last is not None and last[0] not in DONE and millis(update[2]) - millis(last[2]) > self.timeout_ms:
                due = millis(last[2]) + self.timeout_ms
                if due > timerValues.getCurrentWatermarkInMs():
                    yield self._stalled(key[0], last)
            last = update
        self.last.update(last)
        for timer in timers:
            self.handle.deleteTimer(timer)
        if last[0] not in DONE:
            clock = millis(last[2]) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(clock + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and tuple(self.last.get())[0] not in DONE:
            yield self._stalled(key[0], tuple(self.last.get()))

    def close(self) -> None:
        pass
