"""The query surface: released statistics of one complete window, and nothing else.

Only fixed windows and fixed levels can be asked for; free filters and time ranges would let answers be combined to work
around suppression, so there are none.
"""

from __future__ import annotations

import datetime as dt
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.functions import hll
from veilstream.functions.dp import noisy_users
from veilstream.operators.rollup import fetch_cell, fetch_children
from veilstream.operators.suppress import presented, release_global, suppress
from veilstream.plans.model import ANY, ANY_NAMESPACE, FAMILY, GLOBAL, NAMESPACE, WIKI, WINDOW, Settings
from veilstream.sources.store import CellStore


class BadRequest(ValueError):
    """Parameters don't name a cell (status 400)."""

    status = 400


class Incomplete(RuntimeError):
    """Some partition hasn't flushed the window yet (status 409)."""

    status = 409


def check(level: int, family: str | None, wiki: str | None, estimator: str) -> None:
    if not GLOBAL <= level <= NAMESPACE:
        raise BadRequest("level must be between 0 and 3")
    if level >= WIKI and family is None:
        raise BadRequest("family is required for level >= 2")
    if level >= NAMESPACE and wiki is None:
        raise BadRequest("wiki is required for level >= 3")
    if estimator not in ("exact", "hll"):
        raise BadRequest("estimator must be exact or hll")


def parent_key(level: int, family: str | None, wiki: str | None) -> dict:
    """The parent cell of what is asked for."""
    return {"level": level - 1, "family": family if level >= WIKI else ANY, "wiki": wiki if level >= NAMESPACE else ANY, "namespace": ANY_NAMESPACE}


def is_complete(window: dt.datetime, min_watermark: dt.datetime | None, size: dt.timedelta = dt.timedelta(seconds=60)) -> bool:
    """Has every partition flushed past the window's end? Without progress nothing is complete."""
    return min_watermark is not None and window + size <= min_watermark


def latest_window(min_watermark: dt.datetime | None, size: dt.timedelta = dt.timedelta(seconds=60)) -> dt.datetime | None:
    """The last complete window: the least watermark's window, less one."""
    if min_watermark is None:
        return None
    epoch = dt.datetime(1970, 1, 1, tzinfo=min_watermark.tzinfo)
    return epoch + (min_watermark - epoch) // size * size - size


def hll_counts(partial: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, events, users): exact events, users estimated from merged sketches; missing or broken sketches count nothing."""
    sums = partial.groupBy(*keys).agg(F.sum("events").cast("long").alias("events"))
    merged = hll.merge(hll.from_bytes(partial, keys), keys)
    users = hll.estimate(merged, keys).select(*keys, F.round("estimate").cast("long").alias("users"))
    return sums.join(users, keys, "left").withColumn("users", F.coalesce("users", F.lit(0)))


class Stats:
    """Answers for one store. Released rows are kept by (window, level, needed axes, estimator)."""

    def __init__(self, store: CellStore, settings: Settings | None = None, size: str = WINDOW, dp_seed: str = ""):
        self.store, self.settings, self.dp_seed = store, settings or Settings(), dp_seed
        number, unit = size.split()
        self.size = dt.timedelta(**{unit if unit.endswith("s") else unit + "s": int(number)})
        self._kept: OrderedDict[tuple, DataFrame] = OrderedDict()

    def latest_window(self) -> dt.datetime | None:
        return latest_window(self.store.min_watermark(), self.size)

    def stats(self, window: dt.datetime, level: int, family: str | None = None, wiki: str | None = None, estimator: str = "exact") -> DataFrame:
        """Released rows (window_start, kind, family, wiki, namespace, events, users), in order of presentation."""
        check(level, family, wiki, estimator)
        if not is_complete(window, self.store.min_watermark(), self.size):
            raise Incomplete("window is not yet fully flushed by every partition")
        key = (window, level, family if level >= WIKI else None, wiki if level >= NAMESPACE else None, estimator)
        if key not in self._kept:
            rows = self._compute(*key).collect()  # one window's released rows of one parent
            self._kept[key] = self.store.spark.createDataFrame(rows, "window_start timestamp, kind string, family string, wiki string, namespace int, events long, users long")
            while len(self._kept) > self.settings.cache_capacity:
                self._kept.popitem(last=False)
        self._kept.move_to_end(key)
        return self._kept[key]

    def _compute(self, window: dt.datetime, level: int, family: str | None, wiki: str | None, estimator: str) -> DataFrame:
        cells, k = self.store.cells(window), self.settings.privacy_k
        at = F.lit(window).cast("timestamp").alias("window_start")
        if level == GLOBAL:
            row = fetch_cell(cells, window, GLOBAL)
            released = release_global(row.select(at, F.lit(GLOBAL).alias("level"), "*"), k)
            if estimator == "hll":  # the decision is made on exact counts, the estimate is released
                users = hll_counts(cells.filter(F.col("level") == GLOBAL), ["window_start"]).select("window_start", F.col("users").alias("estimated"))
                released = released.join(users, "window_start").withColumn("users", F.col("estimated")).drop("estimated")
        else:
            parent = fetch_cell(cells, window, **parent_key(level, family, wiki)).select(F.col("users").alias("parent_users"))
            children = fetch_children(cells, window, level, family, wiki).crossJoin(F.broadcast(parent))  # one row
            released = suppress(children.select(at, "*"), ["window_start"], k)
            if estimator == "hll":
                names = ["family", "wiki", "namespace"]
                users = hll_counts(cells.filter(F.col("level") == level), names).select(*names, F.col("users").alias("estimated"))
                released = released.join(users, names, "left").withColumn("users", F.coalesce("estimated", "users")).drop("estimated")
        key = ["window_start", "kind", "family", "wiki", "namespace"]
        noisy = noisy_users(released.withColumn("level", F.lit(level)), [*key, "level"], f"{self.dp_seed}|{estimator}", self.settings.dp_epsilon, self.settings.dp_enabled)
        return presented(noisy.select(*key, "events", "users"))


__all__ = ["BadRequest", "FAMILY", "Incomplete", "Stats", "check", "hll_counts", "is_complete", "latest_window", "parent_key"]
