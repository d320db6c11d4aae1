"""The streaming pipeline: validated, pseudonymized events to closed windows in the store, exactly once.

The watermark is Spark's: one for the query, from the largest event time less the lateness. A window is emitted once it has
ended at or before the watermark, and a row is dropped as late only if its window has been emitted. Repeated event
ids are dropped within their window; the state of emitted windows is freed. Distinct users are counted by two
group-bys, so that state is many small keys instead of large sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilstream.functions import hll
from veilstream.functions.pseudonym import pseudonymize, pseudonymize_secret
from veilstream.functions.scalar import kpartition
from veilstream.operators.rollup import fan_out, rolled_up
from veilstream.operators.validate import validation_error
from veilstream.plans.model import CELL, LATENESS, PARTITIONS, WINDOW, Settings
from veilstream.sources.store import CellStore


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(events: DataFrame, now: Column, settings: Settings | None = None, partitions: int = PARTITIONS) -> DataFrame:
    """Valid events under their pseudonym, with the partition that the pseudonym has. A given salt is for tests; else executors read theirs."""
    salt = settings.pseudonym_salt if settings else ""
    fine = events.withColumn("__error", validation_error(now)).filter("__error IS NULL").drop("__error")
    hidden = fine.withColumn("user", pseudonymize(F.col("user"), salt) if salt else pseudonymize_secret(F.col("user")))
    return hidden.withColumn("kpartition", kpartition(F.col("user"), partitions))


def deduplicated(events: DataFrame, size: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Events with their window ``w``, each id once in it. ``ts`` must be a timestamp with zone."""
    windowed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn("w", F.window("ts", size))
    return windowed.dropDuplicates(["w", "event_id"])


def stream_cells(events: DataFrame, size: str = WINDOW, lateness: str = LATENESS, sketches: bool = False) -> DataFrame:
    """(window_start, level, family, wiki, namespace, kpartition, events, users[, users_hll]) of closed windows.

    Events are counted per user and finest cell before they are fanned out, so that the state of open windows holds these counts
    and not each event four times. With sketches, users are summed by register first: a cell's sketch is gathered from at most 4,096 rows.
    """
    keys = ["w", *CELL, "kpartition"]
    finest = deduplicated(events, size, lateness).groupBy("w", "family", "wiki", "namespace", "kpartition", "user").agg(F.count("*").alias("n"))
    per_user = fan_out(finest).groupBy(*keys, "user").agg(F.sum("n").alias("n"))
    columns = [F.col("w.start").alias("window_start"), *CELL, "kpartition", "events", "users"]
    if not sketches:
        return per_user.groupBy(*keys).agg(F.sum("n").cast("long").alias("events"), F.count("*").alias("users")).select(*columns)
    idx, rho = hll.register(F.col("hash"))
    hashed = per_user.withColumn("hash", hll.hash64(F.col("user"))).select(*keys, "n", idx.alias("idx"), rho.alias("rho"))
    by_register = hashed.groupBy(*keys, "idx").agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.max("rho").alias("rho"))
    summed = by_register.groupBy(*keys).agg(F.sum("n").cast("long").alias("events"), F.sum("m").cast("long").alias("users"), F.collect_list(F.struct("idx", "rho")).alias("filled"))
    return summed.select(*columns, hll.sketch_bytes(F.col("filled")).alias("users_hll"))


def stream_counts(events: DataFrame, size: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """(window_start, family, wiki, namespace, kpartition, user, n) of closed windows: what ``closed_cells`` makes cells of.

    A window's rows all come in the batch that closes it, so its cells need no state of their own: the state is that of ids and of one
    count for each user and finest cell.
    """
    counts = deduplicated(events, size, lateness).groupBy("w", "family", "wiki", "namespace", "kpartition", "user").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "family", "wiki", "namespace", "kpartition", "user", "n")


def closed_cells(counts: DataFrame, sketches: bool = False) -> DataFrame:
    """Cells of the windows that a batch of ``stream_counts`` closes."""
    cells = rolled_up(counts, ["window_start", "kpartition"])
    if not sketches:
        return cells
    keys = ["window_start", *CELL, "kpartition"]
    stored = hll.to_bytes(hll.registers(fan_out(counts), keys), keys)
    return cells.join(stored, keys, "left")


def stream_sketches(events: DataFrame, size: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Cells with Spark's own sketch of the users instead of their count; state of fixed size for each cell."""
    cells = fan_out(deduplicated(events, size, lateness).select("w", "family", "wiki", "namespace", "kpartition", "user"))
    return cells.groupBy("w", *CELL, "kpartition").agg(F.count("*").alias("events"), hll.native_sketch(F.col("user")).alias("sketch")).select(F.col("w.start").alias("window_start"), *CELL, "kpartition", "events", "sketch")


def flush_to(store: CellStore, partitions: int = PARTITIONS, size: str = WINDOW, sketches: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: closed windows replace what the store has of them, then every partition's progress moves on.

    It takes cells, or counts per user, of which it makes cells.

    Progress is written for all partitions whenever a window closes, so that a silent one doesn't hold windows back.
    """

    def flush(closed: DataFrame, batch: int) -> None:
        rows = (closed_cells(closed, sketches) if "user" in closed.columns else closed).persist()
        try:
            last = rows.agg(F.max("window_start")).first()[0]
            if last is None:
                return
            end = F.lit(last) + F.expr(f"INTERVAL {size}")
            progress = closed.sparkSession.range(partitions).select(F.col("id").cast("int").alias("kpartition"), F.lit(batch).cast("long").alias("committed_offset"), end.alias("flushed_watermark"))
            store.flush(rows, progress, batch)
        finally:
            rows.unpersist()

    return flush


def start(cells: DataFrame, store: CellStore, checkpoint: str, partitions: int = PARTITIONS, size: str = WINDOW, every: str | None = None, sketches: bool = False) -> StreamingQuery:
    """Run until stopped, or over all that is there if no interval is given. State is kept in RocksDB, outside the heap."""
    conf = cells.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)  # a query keeps what is set when it starts
    try:
        writer = cells.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(flush_to(store, partitions, size, sketches))
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
