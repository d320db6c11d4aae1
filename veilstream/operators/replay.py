"""Late events and watermarks, replayed in batch: what a stream in a given order of arrival would have dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstream.functions.scalar import window_end, window_start
from veilstream.plans.model import LATENESS, WINDOW


def arrivals(events: DataFrame, arrival: Column, partition: list[str], size: str = WINDOW, lateness: str = LATENESS, tie: str = "event_id") -> DataFrame:
    """Events with ``window_start``, ``watermark`` (before the event) and ``late``.

    The watermark of a partition is the largest event time of the events that came before, less the lateness; late and
    repeated events move it too. An event is late iff its window ended at or before it.
    """
    order = Window.partitionBy(*partition).orderBy("arrival", tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("arrival", arrival).withColumn("window_start", window_start(F.col("ts"), size))
    marked = rows.withColumn("watermark", F.max("ts").over(order) - F.expr(f"INTERVAL {lateness}"))
    return marked.withColumn("late", F.coalesce(window_end(F.col("window_start"), size) <= F.col("watermark"), F.lit(False)))


def outcomes(arrived: DataFrame, tie: str = "event_id") -> DataFrame:
    """Events with ``outcome``: Late, Duplicate of an earlier one in the window, or Accepted."""
    first = Window.partitionBy("window_start", tie, "late").orderBy("arrival")
    return arrived.withColumn("outcome", F.when(F.col("late"), F.lit("Late")).when(F.row_number().over(first) > 1, F.lit("Duplicate")).otherwise(F.lit("Accepted")))


def committed_offsets(events: DataFrame, watermark: Column, size: str = WINDOW) -> DataFrame:
    """(kpartition, committed_offset): the least offset among open windows, or the next one if none is open."""
    rows = events.withColumn("open", window_end(window_start(F.col("ts"), size), size) > watermark)
    return rows.groupBy("kpartition").agg(F.coalesce(F.min(F.when(F.col("open"), F.col("offset"))), F.max("offset") + 1).alias("committed_offset"))


def latency_quantiles(rows: DataFrame, value: str) -> DataFrame:
    """p50, p95, p99 and the largest, to three digits at least."""
    q = lambda p: F.percentile_approx(value, p, 100_000)
    return rows.agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(value).alias("max"))
