"""A watermark for each partition, with an idle rule: the stateful form of the pipeline.

``PartitionWindows`` keeps, for one partition, the largest event time and the flushed watermark, and for each open window the
ids that were seen and the users of its cells: one state entry a window, read and written once a batch. Every
consumed event moves the largest time, late and repeated ones too. After each batch, windows that ended at or before the
watermark are emitted and freed, and the partition's progress is emitted, also when nothing closed. A partition
without events for ``idle_seconds`` takes the wall clock as its largest time, so that its windows close.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veilstream.plans.model import ANY, ANY_NAMESPACE, IDLE_SECONDS

OUTPUT = "kpartition int, window_start timestamp, level int, family string, wiki string, namespace int, events long, users long, flushed_watermark timestamp, late long, duplicates long"
NAMES = [x.split()[0] for x in OUTPUT.split(", ")]
SECOND, DAY = 10**6, 86_400 * 10**6
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts: pd.Series) -> pd.Series:
    plain = ts.dt.tz_convert("UTC").dt.tz_localize(None) if ts.dt.tz is not None else ts
    return plain.astype("datetime64[us]").astype("int64")


class Window:
    """What is open of one window: ids, and per finest cell how often each user came."""

    def __init__(self, raw: str | None = None):
        kept = json.loads(raw) if raw else {"ids": [], "cells": []}
        self.ids = set(kept["ids"])
        self.cells = {(f, w, n): dict(users) for f, w, n, users in kept["cells"]}

    def dump(self) -> str:
        return json.dumps({"ids": sorted(self.ids), "cells": [[f, w, n, users] for (f, w, n), users in self.cells.items()]})

    def add(self, event_id: str, cell: tuple, user: str) -> bool:
        if event_id in self.ids:
            return False
        self.ids.add(event_id)
        users = self.cells.setdefault(cell, {})
        users[user] = users.get(user, 0) + 1
        return True

    def totals(self) -> dict[tuple, tuple[int, int]]:
        """(events, users) of the cells of all levels."""
        found: dict[tuple, dict[str, int]] = {}
        for (family, wiki, namespace), users in self.cells.items():
            for cell in ((0, ANY, ANY, ANY_NAMESPACE), (1, family, ANY, ANY_NAMESPACE), (2, family, wiki, ANY_NAMESPACE), (3, family, wiki, namespace)):
                into = found.setdefault(cell, {})
                for user, n in users.items():
                    into[user] = into.get(user, 0) + n
        return {cell: (sum(users.values()), len(users)) for cell, users in found.items()}


class PartitionClock:
    """The arithmetic of one partition, apart from Spark's state; times are microseconds."""

    def __init__(self, size: int, lateness: int, latest: int | None = None, flushed: int | None = None):
        self.size, self.lateness, self.latest, self.flushed = size, lateness, latest, flushed
        self.new = latest is None

    def see(self, ts: int) -> int | None:
        """Take note of an event; its window, or None if it is late."""
        if self.new:  # a new partition has flushed nothing; the rows of its first batch come in any order
            self.latest, self.flushed = (ts - DAY if x is None else x for x in (self.latest, self.flushed))
            self.flushed = min(self.flushed, ts - DAY)
        self.latest = max(self.latest, ts)
        window = ts // self.size * self.size
        return None if window + self.size <= self.flushed else window

    def idle(self, now: int) -> None:
        self.latest = max(self.latest, now)

    def close(self, windows: list[int]) -> list[int]:
        """The windows that are closed now, in order; the flushed watermark never goes back."""
        watermark = self.latest - self.lateness
        self.flushed = max(self.flushed, watermark)
        return sorted(w for w in windows if w + self.size <= watermark)


class PartitionWindows(StatefulProcessor):
    def __init__(self, size_seconds: int = 60, lateness_seconds: int = 30, idle_seconds: int = IDLE_SECONDS):
        self.size, self.lateness, self.idle = size_seconds * SECOND, lateness_seconds * SECOND, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "latest long, flushed long")
        self.windows = handle.getMapState("windows", "window long", "content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = PartitionClock(self.size, self.lateness, *(self.clock.get() if self.clock.exists() else ()))
        touched: dict[int, Window] = {}
        late = duplicates = 0
        for frame in rows:
            for ts, row in zip(_micros(frame["ts"]).tolist(), frame.itertuples(index=False), strict=True):
                window = clock.see(ts)
                if window is None:
                    late += 1
                    continue
                if window not in touched:
                    touched[window] = Window(self.windows.getValue((window,))[0] if self.windows.containsKey((window,)) else None)
                duplicates += not touched[window].add(row.event_id, (row.family, row.wiki, int(row.namespace)), row.user)
        if clock.latest is not None:
            yield self._close(key, clock, touched, late, duplicates)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists():
            clock = PartitionClock(self.size, self.lateness, *self.clock.get())
            clock.idle(timerValues.getCurrentProcessingTimeInMs() * 1000)
            yield self._close(key, clock, {}, 0, 0)

    def _close(self, key, clock: PartitionClock, touched: dict[int, Window], late: int, duplicates: int) -> pd.DataFrame:
        known = {int(k[0]) for k in self.windows.keys()} | touched.keys()
        closed = clock.close(list(known))
        stamp = lambda us: pd.Timestamp(us, unit="us", tz="UTC")
        rows = []
        for w in closed:
            window = touched.pop(w, None) or Window(self.windows.getValue((w,))[0])
            rows += [(int(key[0]), stamp(w), *cell, n, users, stamp(clock.flushed), 0, 0) for cell, (n, users) in sorted(window.totals().items())]
            if self.windows.containsKey((w,)):
                self.windows.removeKey((w,))
        for w, window in touched.items():
            self.windows.updateValue((w,), (window.dump(),))
        self.clock.update((clock.latest, clock.flushed))
        rows.append((int(key[0]), None, None, None, None, None, None, None, stamp(clock.flushed), late, duplicates))
        frame = pd.DataFrame(rows, columns=NAMES)
        for c in ("level", "namespace", "events", "users"):
            frame[c] = frame[c].astype("Int64")
        frame["window_start"] = pd.to_datetime(frame["window_start"], utc=True)
        return frame

    def close(self) -> None:
        return None


def partition_cells(events: DataFrame, **options) -> DataFrame:
    """Closed cells and progress rows (window_start null) of a stream of events with ``kpartition``. Needs the RocksDB state store."""
    rows = events.select("kpartition", "event_id", "user", "ts", "family", "wiki", "namespace")
    return rows.groupBy("kpartition").transformWithStateInPandas(PartitionWindows(**options), OUTPUT, "Append", "ProcessingTime")


def run_available(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over all input that is there, into Parquet. Timers alone start no further batches."""
    conf = cells.sparkSession.conf
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        query = cells.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
