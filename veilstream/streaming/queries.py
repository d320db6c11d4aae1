"""Registered streaming queries: a file stream over the driver's events, run until all input is read.

Spark's watermark stays open on the last windows until later events come, so a marker far in the future is added
and left out of the result; all windows of the data close, and the batch result is the oracle.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.operators.rollup import finalize
from veilstream.operators.suppress import release
from veilstream.plans.queries import CLICK_CELLS, _suppress_sql
from veilstream.sources.adapters import clicks
from veilstream.sources.store import CellStore
from veilstream.session import work_dir
from veilstream.streaming.partitioned import partition_cells, run_available
from veilstream.streaming.pipeline import start, stream_counts

MARKER = "2030-01-01 00:00:00"
#: Rows of a file of the stream.
FILE_ROWS = 250_000


def _input(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A stream of two drops of files: the clicks, each third one sent again six hours later, then the marker.

    The files hold consecutive stretches of time and come in that order, however many triggers they take: no click is late.
    """
    events = clicks(spark, sf_dir).drop("value").withColumn("kpartition", F.pmod(F.col("user").cast("long"), F.lit(12)).cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
    again = events.filter(F.col("event_id").cast("long") % 3 == 0).withColumn("sent", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    twice = events.withColumn("sent", F.col("ts")).unionByName(again)
    twice.repartitionByRange(max(1, -(-twice.count() // FILE_ROWS)), "sent").drop("sent").write.parquet(f"{folder}/drop=1")
    last = spark.range(12).select(
        F.concat(F.lit("marker-"), "id").alias("event_id"), F.lit("0").alias("user"), F.lit(MARKER).cast("timestamp").alias("ts"), F.lit("-").alias("family"), F.lit("-").alias("wiki"),
        F.lit(0).alias("namespace"), F.col("id").cast("int").alias("kpartition"),
    )
    last.coalesce(1).write.parquet(f"{folder}/drop=2")
    _put_in_order(spark, [f"{folder}/drop=1", f"{folder}/drop=2"])
    return spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/drop=*")


def _put_in_order(spark: SparkSession, folders: list[str]) -> None:
    """Date the files of the folders a second apart, by folder and number of the task: a file stream reads by modification time."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path_of(folders[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files() -> list:
        found = [[s for s in fs.listStatus(path_of(f)) if s.getPath().getName().startswith("part-")] for f in folders]
        return [s for f in found for s in sorted(f, key=lambda s: (int(s.getPath().getName().split("-")[1]), s.getPath().getName()))]

    written = files()
    first = int(time.time()) - len(written)
    for n, status in enumerate(written):
        fs.setTimes(status.getPath(), (first + n) * 1000, -1)
    dates = [s.getModificationTime() for s in files()]
    if any(a >= b for a, b in zip(dates, dates[1:], strict=False)):
        raise RuntimeError("the file system of spark.checkpoint.dir doesn't keep modification times, which the stream's files are ordered by")


def _stored(spark: SparkSession, sf_dir: str) -> CellStore:
    folder = work_dir(spark, "stream")
    store = CellStore(spark, f"{folder}/store")
    query = start(stream_counts(_input(spark, sf_dir, f"{folder}/in"), "1 day", "1 day"), store, f"{folder}/checkpoint", size="1 day")
    query.awaitTermination()
    return store


def _closed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).filter(F.col("window_start") < MARKER)


def stream_cells_e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all days, out of the store that the stream has filled."""
    return _closed(finalize(_stored(spark, sf_dir).cells())).withColumn("level", F.col("level").cast("int"))


def stream_released_e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released rows of level 2, out of the store that the stream has filled."""
    return release(stream_cells_e1(spark, sf_dir), 2)


def stream_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the stateful form, with a watermark for each partition."""
    folder = work_dir(spark, "partitioned")
    cells = partition_cells(_input(spark, sf_dir, f"{folder}/in"), size_seconds=86_400, lateness_seconds=86_400 * 40)
    run_available(cells, f"{folder}/out", f"{folder}/checkpoint")
    rows = spark.read.schema(cells.schema).parquet(f"{folder}/out").filter("window_start IS NOT NULL")
    return _closed(finalize(rows)).withColumn("level", F.col("level").cast("int"))


_CELLS = f"WITH {CLICK_CELLS} SELECT window_start, level, family, wiki, namespace, events, users FROM cells"

STREAMS = {"stream_cells_e1": stream_cells_e1, "stream_released_e1": stream_released_e1, "stream_partitioned": stream_partitioned}
STREAM_ORACLES = {"stream_cells_e1": _CELLS, "stream_released_e1": _suppress_sql(CLICK_CELLS, 2, 10), "stream_partitioned": _CELLS}

