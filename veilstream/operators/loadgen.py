"""A load generator: a reproducible stream of events with repeated and late ones, and its truth.

Everything is a function of the seed and the event's number, so the same call gives the same events, in parallel
and again after a lost task.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.operators.reconcile import truth_cells
from veilstream.plans.model import WINDOW

# The wikis, most frequent first.
WIKIS = [
    ("wikipedia", "enwiki"), ("wikipedia", "knwiki"), ("wikipedia", "dewiki"), ("wikipedia", "frwiki"), ("wikipedia", "jawiki"),
    ("wiktionary", "enwiktionary"), ("wikidata", "wikidatawiki"), ("commons", "commonswiki"),
]


@dataclass(frozen=True)
class Load:
    rate: int = 200
    seconds: int = 60
    batch_size: int = 100
    users: int = 5000
    user_exponent: float = 1.2
    wiki_exponent: float = 1.0
    duplicates: float = 0.01
    late: float = 0.005
    seed: int = 42
    start: dt.datetime = dt.datetime(2026, 1, 1)

    @property
    def total(self) -> int:
        return self.rate * self.seconds

    @property
    def batches(self) -> int:
        return -(-self.total // self.batch_size)


def uniform(seed: int, name: str) -> Column:
    """Uniform in [0, 1) of an event's number, another one for each name."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), F.col("n")), 11)
    return bits.cast("double") / float(2**53)


def _zipf_rank(u: Column, n: int, exponent: float) -> Column:
    """Rank 1..n by inversion of the cumulative weights; the table's length is a setting."""
    weights = np.arange(1, n + 1) ** -exponent
    below = (np.cumsum(weights) / weights.sum())[:-1]
    table = F.array(*[F.lit(float(x)) for x in below]) if n <= 64 else None
    if table is not None:
        return F.size(F.filter(table, lambda x: x <= u)) + 1

    @F.pandas_udf("int")
    def rank(values):
        return values.map(lambda v: int(np.searchsorted(below, v, "right")) + 1)

    return rank(u)


def unique_events(spark: SparkSession, load: Load) -> DataFrame:
    """Events before repetition, in order ``n``."""
    rows = spark.range(load.total).withColumnRenamed("id", "n")
    u = lambda name: uniform(load.seed, name)
    place = _zipf_rank(u("wiki"), len(WIKIS), load.wiki_exponent)
    back = F.when(u("late") < load.late, F.floor(u("back") * 27) + 1).otherwise(F.lit(0))
    micros = F.floor(F.col("n") * (1_000_000 / load.rate)).cast("long") - back * 1_000_000
    pick = lambda name, *cuts: (F.when(u(name) < cuts[0][0], F.lit(cuts[0][1])).when(u(name) < cuts[1][0], F.lit(cuts[1][1])).when(u(name) < cuts[2][0], F.lit(cuts[2][1])).otherwise(F.lit(cuts[-1][1])))
    return rows.select(
        "n", F.md5(F.concat_ws("-", F.lit(load.seed), F.col("n")).cast("binary")).alias("event_id"),
        F.concat(F.lit("loadgen-user-"), _zipf_rank(u("user"), load.users, load.user_exponent).cast("string")).alias("user"),
        F.timestamp_micros(F.lit(int(load.start.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)) + micros).alias("ts"),
        F.element_at(F.array(*[F.lit(f) for f, _ in WIKIS]), place).alias("family"), F.element_at(F.array(*[F.lit(w) for _, w in WIKIS]), place).alias("wiki"),
        pick("namespace", (0.7, 0), (0.9, 1), (1.0, 2), (1.0, 2)).alias("namespace"), pick("kind", (0.7, "edit"), (0.8, "new"), (0.9, "log"), (1.0, "categorize")).alias("kind"),
        F.lit(False).alias("is_bot"), F.floor(F.col("n") / load.batch_size).cast("int").alias("batch_id"),
    )


def stream(spark: SparkSession, load: Load) -> DataFrame:
    """Events as sent: some twice, the copy right behind."""
    events = unique_events(spark, load)
    copies = F.when(uniform(load.seed, "duplicate") < load.duplicates, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return events.withColumn("copy", F.explode(copies))


def truth(spark: SparkSession, load: Load, size: str = WINDOW) -> DataFrame:
    """What must come out."""
    return truth_cells(unique_events(spark, load), size)


def feed(spark: SparkSession, load: Load, folder: str, batches_per_file: int = 10, paced: bool = False) -> int:
    """Drop the stream as files in order of time, an open loop: paced, each file when its last event is due, late ones at once.

    Returns the number of files.
    """
    events = stream(spark, load).drop("copy", "n")
    files = -(-load.batches // batches_per_file)
    began = time.monotonic()
    for k in range(files):
        due = (k + 1) * batches_per_file * load.batch_size / load.rate
        if paced and (wait := began + due - time.monotonic()) > 0:
            time.sleep(wait)
        part = events.filter(F.col("batch_id").between(k * batches_per_file, (k + 1) * batches_per_file - 1)).drop("batch_id")
        part.coalesce(1).write.mode("append").parquet(folder)
    return files
