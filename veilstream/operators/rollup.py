"""The fixed hierarchy: fan-out, batch rollup, partial rows per partition, and cell reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.functions.scalar import window_start
from veilstream.plans.model import ANY, ANY_NAMESPACE, CELL, FAMILY, GLOBAL, NAMESPACE, WIKI, WINDOW


def cell(level: int) -> Column:
    """The cell of an event at a level."""
    return F.struct(
        F.lit(level).alias("level"),
        (F.col("family") if level >= FAMILY else F.lit(ANY)).alias("family"),
        (F.col("wiki") if level >= WIKI else F.lit(ANY)).alias("wiki"),
        (F.col("namespace") if level >= NAMESPACE else F.lit(ANY_NAMESPACE)).alias("namespace"),
    )


def global_cell() -> dict:
    return {"level": GLOBAL, "family": ANY, "wiki": ANY, "namespace": ANY_NAMESPACE}


def fan_out(events: DataFrame) -> DataFrame:
    """Each event in its four cells: the event's other columns with level, family, wiki and namespace of the cell."""
    others = [c for c in events.columns if c not in CELL]
    return events.select(*others, F.explode(F.array(*[cell(n) for n in (GLOBAL, FAMILY, WIKI, NAMESPACE)])).alias("cell")).select(*others, "cell.*")


def parent_columns() -> list[Column]:
    """Level and axes of a cell's parent; null for the global cell."""
    level = F.col("level")
    return [
        F.when(level > 0, level - 1).cast("int").alias("parent_level"),
        F.when(level > FAMILY, F.col("family")).when(level == FAMILY, F.lit(ANY)).alias("parent_family"),
        F.when(level > WIKI, F.col("wiki")).when(level > GLOBAL, F.lit(ANY)).alias("parent_wiki"),
        F.when(level > GLOBAL, F.lit(ANY_NAMESPACE)).alias("parent_namespace"),
    ]


def dedup_in_window(events: DataFrame, size: str = WINDOW) -> DataFrame:
    """One row for each event id and window."""
    return events.withColumn("window_start", window_start(F.col("ts"), size)).dropDuplicates(["window_start", "event_id"])


def batch_cells(events: DataFrame, size: str | None = WINDOW, extra: list[str] | None = None) -> DataFrame:
    """(window_start, [extra], level, family, wiki, namespace, events, users) of all four levels, exactly.

    Events are counted per user and finest cell first, so the rollup expands these sums and not the events.
    ``size`` None: the events have a ``window_start`` already.
    """
    extra = extra or []
    windowed = events if size is None else events.withColumn("window_start", window_start(F.col("ts"), size))
    keys = ["window_start", *extra]
    return rolled_up(windowed.groupBy(*keys, "family", "wiki", "namespace", "user").agg(F.count("*").alias("n")), keys)


def rolled_up(finest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family, wiki, namespace, user, n), one row a user and finest cell, to the cells of all four levels."""
    rolled = finest.sparkSession.sql(
        f"""
        SELECT {", ".join(keys)}, family, wiki, namespace, grouping_id() AS rolled,
          sum(n) AS events, count(DISTINCT user) AS users
        FROM {{finest}} GROUP BY {", ".join(keys)}, ROLLUP (family, wiki, namespace)""",
        finest=finest,
    )
    of = lambda name, bit, else_: F.when(F.col("rolled").bitwiseAND(bit) != 0, F.lit(else_)).otherwise(F.col(name)).alias(name)
    level = F.when(F.col("rolled") == 7, GLOBAL).when(F.col("rolled") == 3, FAMILY).when(F.col("rolled") == 1, WIKI).otherwise(NAMESPACE)
    return rolled.select(*keys, level.cast("int").alias("level"), of("family", 4, ANY), of("wiki", 2, ANY), of("namespace", 1, ANY_NAMESPACE), F.col("events").cast("long").alias("events"), "users")


def partials(events: DataFrame, kpartition: Column, size: str | None = WINDOW) -> DataFrame:
    """Cells per partition. The partition must depend on the user alone."""
    return batch_cells(events.withColumn("kpartition", kpartition.cast("int")), size, ["kpartition"])


def finalize(partial: DataFrame) -> DataFrame:
    """Sums over partitions: distinct counts add up, as no user is in two partitions."""
    return partial.groupBy("window_start", *CELL).agg(F.sum("events").cast("long").alias("events"), F.sum("users").cast("long").alias("users"))


def fetch_cell(partial: DataFrame, window, level: int, family: str = ANY, wiki: str = ANY, namespace: int = ANY_NAMESPACE) -> DataFrame:
    """One row (events, users), zeros if the cell doesn't exist."""
    one = partial.filter((F.col("window_start") == F.lit(window)) & (F.col("level") == level) & (F.col("family") == family) & (F.col("wiki") == wiki) & (F.col("namespace") == namespace))
    return one.agg(F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events"), F.coalesce(F.sum("users"), F.lit(0)).cast("long").alias("users"))


def fetch_children(partial: DataFrame, window, level: int, family: str | None = None, wiki: str | None = None) -> DataFrame:
    """Summed cells at ``level`` below the parent that family and wiki name."""
    rows = partial.filter((F.col("window_start") == F.lit(window)) & (F.col("level") == level))
    if level >= WIKI:
        rows = rows.filter(F.col("family") == family)
    if level >= NAMESPACE:
        rows = rows.filter(F.col("wiki") == wiki)
    return rows.groupBy("family", "wiki", "namespace").agg(F.sum("events").cast("long").alias("events"), F.sum("users").cast("long").alias("users"))
