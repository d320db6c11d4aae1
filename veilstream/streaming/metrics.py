"""Counters and gauges of running queries, from Spark's progress reports."""

from __future__ import annotations

import datetime as dt
import threading
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Totals by name; ``rate`` is a counter's growth per second over the last two reports."""

    def __init__(self):
        self._lock = threading.Lock()
        self.totals: dict[str, float] = defaultdict(float)
        self._last: dict[str, tuple[float, float]] = {}
        self._rates: dict[str, float] = {}
        self.lag: dict[str, int] = {}

    def count(self, name: str, by: float, at: float | None = None) -> None:
        with self._lock:
            self.totals[name] += by
            if at is not None:
                before = self._last.get(name)
                if before and at > before[0]:
                    self._rates[name] = (self.totals[name] - before[1]) / (at - before[0])
                self._last[name] = (at, self.totals[name])

    def rate(self, name: str) -> float:
        return self._rates.get(name, 0.0)

    def onQueryStarted(self, event) -> None:
        self.count("queries_started", 1)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp()
        self.count("events_processed", p.numInputRows or 0, at)
        for operator in p.stateOperators:
            self.count("late_events", operator.numRowsDroppedByWatermark or 0, at)
            self.count("duplicate_events", float((operator.customMetrics or {}).get("numDroppedDuplicateRows", 0)), at)
        if p.sink is not None and (p.sink.numOutputRows or 0) > 0:
            self.count("rows_flushed", p.sink.numOutputRows, at)
        for name, row in (p.observedMetrics or {}).items():
            for key, value in row.asDict().items():
                self.count(f"{name}_{key}", value or 0, at)
        for source in p.sources:
            for key, value in (source.metrics or {}).items():
                if key in ("maxOffsetsBehindLatest", "avgOffsetsBehindLatest"):
                    self.lag[f"{source.description}:{key}"] = int(float(value))

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        self.count("flush_errors", 1 if event.exception else 0)


def consumer_lag(latest: dict[str, int], consumed: dict[str, int]) -> dict[str, int]:
    """Messages behind, by partition; never negative."""
    return {p: max(high - consumed.get(p, 0), 0) for p, high in latest.items()}


def observed(events: DataFrame, error: str = "error") -> DataFrame:
    """Events with the observation ``ingest``: accepted and refused rows."""
    return events.observe("ingest", F.count_if(F.col(error).isNull()).alias("events_accepted"), F.count_if(F.col(error).isNotNull()).alias("validation_errors"))
