"""The store of aggregates and progress: Parquet partitioned by day, written idempotently by batch.

Every write goes to ``batch=<id>`` and replaces that batch, so a replay changes nothing. A reader takes, per key, the row of
the highest batch: a later flush replaces values, it never adds to them. Progress is written after the cells that
it stands for. ``compact`` folds finished batches into one base, so that readers don't meet ever more folders.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilstream.plans.model import AGG_CELLS, AGG_KEY, PROGRESS


class CellStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path_of = path_of
        self._fs = path_of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path_of(f"{self.path}/{name}"))

    def flush(self, cells: DataFrame, progress: DataFrame, batch: int) -> None:
        """Write closed windows, then progress. Writing a batch again replaces it."""
        rows = cells.select(*[F.col(f.name).cast(f.dataType) if f.name in cells.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in AGG_CELLS.fields])
        days = rows.withColumn("window_date", F.to_date("window_start")).sortWithinPartitions("window_date", "level", "family", "wiki")
        days.write.mode("overwrite").partitionBy("window_date").parquet(f"{self.path}/agg_cells/batch={batch}")
        progress.select(*[F.col(f.name).cast(f.dataType) for f in PROGRESS.fields]).write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch}")

    def _batches(self, name: str) -> list[int]:
        """Finished batches of a folder."""
        at = self._path_of(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and self._exists(f"{name}/{n}/_SUCCESS"))

    def _read(self, name: str, schema: StructType) -> DataFrame:
        """The last base and the batches after it."""
        base = max(self._batches(f"{name}_base"), default=None)
        folders = [f"{name}/batch={b}" for b in self._batches(name) if base is None or b > base]
        parts = [self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])] if folders else []
        if base is not None:
            parts.append(self.spark.read.option("basePath", f"{self.path}/{name}_base").schema(schema).parquet(f"{self.path}/{name}_base/batch={base}"))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def compact(self) -> int | None:
        """Fold all batches whose progress is written into a base, then delete them; returns the base's batch.

        The base counts from the moment its success marker stands, which Spark writes last. To be run by one job at a time.
        """
        done = self._batches("progress")
        if not done:
            return None
        last = done[-1]
        rows = self._read("agg_cells", _with(AGG_CELLS, ("batch", "long"), ("window_date", "date"))).filter(F.col("batch") <= last)
        value = F.struct("events", "users", "users_hll")
        cells = rows.groupBy(*AGG_KEY).agg(F.max_by(value, "batch").alias("v")).select(*AGG_KEY, "v.*").withColumn("window_date", F.to_date("window_start"))
        if last not in self._batches("agg_cells_base"):
            cells.repartition("window_date").sortWithinPartitions("window_date", "level", "family", "wiki").write.mode("overwrite").partitionBy("window_date").parquet(f"{self.path}/agg_cells_base/batch={last}")
        for name in ("agg_cells", "agg_cells_base"):
            for b in self._batches(name):
                if b < last or (b == last and name == "agg_cells"):
                    self._fs.delete(self._path_of(f"{self.path}/{name}/batch={b}"), True)
        return last

    def cells(self, window_start=None) -> DataFrame:
        """Current partial rows; with a window only its day is read."""
        rows = self._read("agg_cells", _with(AGG_CELLS, ("batch", "long"), ("window_date", "date")))
        if window_start is not None:
            rows = rows.filter((F.col("window_date") == F.to_date(F.lit(window_start))) & (F.col("window_start") == F.lit(window_start)))
        value = F.struct("events", "users", "users_hll")
        return rows.groupBy(*AGG_KEY).agg(F.max_by(value, "batch").alias("v")).select(*AGG_KEY, "v.*")

    def progress(self) -> DataFrame:
        """Last progress of each partition."""
        rows = self._read("progress", _with(PROGRESS, ("batch", "long")))
        value = F.struct("committed_offset", "flushed_watermark")
        return rows.groupBy("kpartition").agg(F.max_by(value, "batch").alias("v")).select("kpartition", "v.*")

    def load_progress(self, kpartition: int):
        """(committed_offset, flushed_watermark) of a partition, or None."""
        row = self.progress().filter(F.col("kpartition") == kpartition).first()
        return None if row is None else (row["committed_offset"], row["flushed_watermark"])

    def min_watermark(self):
        """The least flushed watermark of all partitions; None before any progress."""
        return self.progress().agg(F.min("flushed_watermark")).first()[0]

    def drop_before(self, day: dt.date) -> int:
        """Retention: delete whole days before ``day``; returns how many folders went."""
        gone = 0
        for name in ("agg_cells", "agg_cells_base"):
            for b in self._batches(name):
                for folder in self._fs.listStatus(self._path_of(f"{self.path}/{name}/batch={b}")):
                    at = folder.getPath().getName()
                    if at.startswith("window_date=") and at[12:22] < day.isoformat():
                        gone += self._fs.delete(folder.getPath(), True)
        return gone


def _with(schema: StructType, *more: tuple[str, str]) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in more:
        out = out.add(name, kind)
    return out
