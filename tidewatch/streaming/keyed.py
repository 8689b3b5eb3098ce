"""Streaming steps whose state lies in the state store, one small value per key.

State is read and written for the keys of a batch only, an event-time timer ends
what the stream's clock has passed, and a key that is done leaves nothing
behind. A query that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Timers and typed state need the RocksDB store; the session's own setting returns after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def stored(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What the state store holds now: ``key.*`` and ``value.*`` of one state variable."""
    with keyed_store(spark):
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return rows.select("key.*", "value.*")


class _Timed(StatefulProcessor):
    """One value and at most one timer per key."""

    NAME, STATE = "state", ""

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState(self.NAME, self.STATE + ", due_ms long")

    def _load(self):
        return self.value.get() if self.value.exists() else None

    def _store(self, before, fields: tuple | None, due_us: int | None) -> None:
        """Replace the value; its timer rings after ``due_us`` has passed for sure."""
        old = before[-1] if before is not None else None
        due = None if fields is None or due_us is None else due_us // 1000 + 1
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if fields is None:
            if before is not None:
                self.value.clear()
            return
        if due is not None and due != old:
            self.handle.registerTimer(due)
        self.value.update((*fields, due))

    def close(self) -> None:
        pass


class OpenAlerts(_Timed):
    """Alerts of one dedupe key.

    The first hit opens an alert and each further one raises its count. It closes
    through a closing hit (``resolved``), ``quiet_us`` after its last hit
    (``quiet``), or at the expiry that its first hit carries (``expired``),
    without waiting for another row.
    """

    NAME = "alert"
    STATE = "open_alert_id long, occurrence_count long, first_seen_us long, last_seen_us long, expires_us long"
    OUT = "dedupe_key string, open_alert_id long, occurrence_count long, first_seen_us long, last_seen_us long, closed_us long, close_reason string"

    def __init__(self, quiet_us: int):
        self.quiet_us = quiet_us

    def _due(self, alert) -> tuple[int, str]:
        quiet, expires = alert[3] + self.quiet_us, alert[4]
        return (expires, "expired") if expires is not None and expires <= quiet else (quiet, "quiet")

    @staticmethod
    def _closed(key, alert, at_us: int, reason: str) -> Row:
        return Row(
            dedupe_key=key[0], open_alert_id=alert[0], occurrence_count=alert[1], first_seen_us=alert[2],
            last_seen_us=alert[3], closed_us=at_us, close_reason=reason,
        )

    def handleInputRows(self, key, rows, timerValues):
        before = self._load()
        alert = tuple(before[:5]) if before is not None else None
        for hit in sorted(((r.seen_us, r.alert_id, r.closes, r.expires_us) for r in rows), key=lambda h: h[:2]):
            seen_us, alert_id, closes, expires_us = hit
            if alert is not None:
                due, reason = self._due(alert)
                if seen_us > due or (seen_us == due and reason == "expired"):
                    yield self._closed(key, alert, due, reason)
                    alert = None
            alert = (alert_id, 1, seen_us, seen_us, expires_us) if alert is None else (alert[0], alert[1] + 1, alert[2], seen_us, alert[4])
            if closes:
                yield self._closed(key, alert, seen_us, "resolved")
                alert = None
        self._store(before, alert, None if alert is None else self._due(alert)[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self._load()
        if before is not None and before[-1] is not None and before[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            alert = tuple(before[:5])
            yield self._closed(key, alert, *self._due(alert))
            self.value.clear()


class PreviousPosition(_Timed):
    """Each position with the one that arrived before it, if that one is not
    older than ``ttl_us`` by the arrival clock. A key silent for longer has no state."""

    NAME = "position"
    STATE = "effective_us long, lon double, lat double, ingested_us long"
    OUT = "obs_id long, effective_us long, lon double, lat double, prev_us long, prev_lon double, prev_lat double"

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def handleInputRows(self, key, rows, timerValues):
        before = self._load()
        last = tuple(before[:4]) if before is not None else None
        for r in sorted(rows, key=lambda r: (r.arrival, r.obs_id)):
            prev = last if last is not None and r.ingested_us - last[3] <= self.ttl_us else (None, None, None, None)
            yield Row(
                obs_id=r.obs_id, effective_us=r.effective_us, lon=r.lon, lat=r.lat,
                prev_us=prev[0], prev_lon=prev[1], prev_lat=prev[2],
            )
            last = (r.effective_us, r.lon, r.lat, r.ingested_us)
        self._store(before, last, None if last is None else last[3] + self.ttl_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self._load()
        if before is not None and before[-1] is not None and before[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
        return iter(())


class Silences(_Timed):
    """Gaps of more than ``threshold_us`` in the rows of a key.

    The state is the stretches of activity that are not settled yet, however many
    rows they stand for. Once the clock has passed a stretch's end by the
    threshold, an open gap is told (no end); when activity is back and settled, the
    same gap is told with its end.
    """

    NAME = "activity"
    STATE = "starts array<long>, ends array<long>, told boolean"
    OUT = "source_id string, gap_start_us long, gap_end_us long"

    def __init__(self, threshold_us: int):
        self.threshold_us = threshold_us

    def _settle(self, key, starts: list, ends: list, told: bool, now_us: int):
        """Rows that are certain at ``now_us``, what is left, and the next look."""
        out = []
        while len(starts) > 1 and starts[1] <= now_us:
            out.append(Row(source_id=key[0], gap_start_us=ends[0], gap_end_us=starts[1]))
            del starts[0], ends[0]
            told = False
        quiet_us = ends[0] + self.threshold_us
        if not told and quiet_us < now_us and (len(starts) == 1 or starts[1] > now_us):
            out.append(Row(source_id=key[0], gap_start_us=ends[0], gap_end_us=None))
            told = True
        due = starts[1] if len(starts) > 1 else None
        if not told:
            due = quiet_us if due is None else min(due, quiet_us)
        return out, told, due

    def _finish(self, key, before, starts, ends, told, now_us):
        out, told, due = self._settle(key, starts, ends, told, now_us)
        self._store(before, (starts, ends, told), due)
        return out

    def handleInputRows(self, key, rows, timerValues):
        before = self._load()
        starts, ends, told = (list(before[0]), list(before[1]), before[2]) if before is not None else ([], [], False)
        for r in rows:
            t = r.at_us
            # Stretches within reach of t become one with it.
            low, high = bisect_left(ends, t - self.threshold_us), bisect_right(starts, t + self.threshold_us)
            starts[low:high], ends[low:high] = [min([t, *starts[low:high]])], [max([t, *ends[low:high]])]
        yield from self._finish(key, before, starts, ends, told, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        before = self._load()
        if before is not None and before[-1] is not None and before[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            # The timer that rang is gone; the rest is stored anew.
            self.value.clear()
            yield from self._finish(key, None, list(before[0]), list(before[1]), before[2], timerValues.getCurrentWatermarkInMs() * 1000)


def run_keyed(stream: DataFrame, key: str, at: str, delay: str, processor: _Timed, folder: str) -> None:
    """Append what ``processor`` yields for each key of the stream to ``folder/out``.

    ``at`` is the event-time column. Rows older than the newest one less
    ``delay`` are late and left to the late table. Rows of a key in one
    batch are held as small tuples at most, so the load limit of the stream is
    what bounds them.
    """
    spark = stream.sparkSession
    with keyed_store(spark):
        rows = stream.withWatermark(at, delay).groupBy(key).transformWithState(processor, processor.OUT, "append", "eventTime")
        query = (
            rows.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
