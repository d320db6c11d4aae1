"""k-threshold suppression, for all windows and parents in one plan.

A child below k is hidden. What is hidden, with the parent's users that no child accounts for, must have k users or
none: else the smallest visible child is hidden too. One is always enough, since it has k users itself; so the rule
is a window function and no loop. The hidden group comes out as one ``Other`` row if it reaches k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstream.plans.model import ANY, GLOBAL, K, NAMESPACE, WIKI


def suppress(children: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, parent_users, family, wiki, namespace, events, users) to released rows (keys, kind, family, wiki, namespace, events, users).

    ``keys`` name a parent. Ties between smallest children go by family, wiki and namespace.
    """
    by = ", ".join(keys)
    return children.sparkSession.sql(
        f"""
        WITH shares AS (
          SELECT *, users < {int(k)} AS low,
            sum(CASE WHEN users < {int(k)} THEN users ELSE 0 END) OVER p AS low_users,
            greatest(0, coalesce(parent_users, 0) - sum(users) OVER p) AS residual,
            row_number() OVER (PARTITION BY {by} ORDER BY users < {int(k)}, users, family, wiki, namespace) AS place
          FROM {{children}} WINDOW p AS (PARTITION BY {by})),
        decided AS (
          SELECT *, low OR (place = 1 AND low_users + residual > 0 AND low_users + residual < {int(k)}) AS hidden FROM shares),
        other AS (
          SELECT {by}, sum(events) AS events, sum(users) + max(residual) AS users FROM decided WHERE hidden GROUP BY {by})
        SELECT {by}, 'Visible' AS kind, family, wiki, namespace, CAST(events AS BIGINT) AS events, CAST(users AS BIGINT) AS users FROM decided WHERE NOT hidden
        UNION ALL
        SELECT {by}, 'Other', NULL, NULL, NULL, CAST(events AS BIGINT), CAST(users AS BIGINT) FROM other WHERE users >= {int(k)}""",
        children=children,
    )


def with_parents(cells: DataFrame, level: int) -> tuple[DataFrame, list[str]]:
    """Cells of a level with ``parent_users`` (0 without a parent row), and the columns that name a parent."""
    axes = [*(["family"] if level >= WIKI else []), *(["wiki"] if level >= NAMESPACE else [])]
    keys = ["window_start", *(f"parent_{a}" for a in axes)]
    # A parent has the axes that name it in common with its children, so both levels of one rollup meet in a window.
    both = cells.filter(F.col("level").isin(level - 1, level)).withColumns({f"parent_{a}": F.col(a) for a in axes})
    parent = F.max(F.when(F.col("level") == level - 1, F.col("users"))).over(Window.partitionBy(*keys))
    children = both.withColumn("parent_users", F.coalesce(parent, F.lit(0))).filter(F.col("level") == level)
    return children.select(*keys, "family", "wiki", "namespace", "events", "users", "parent_users"), keys


def release(cells: DataFrame, level: int, k: int = K) -> DataFrame:
    """The released rows of a level, over all windows and parents."""
    if level == GLOBAL:
        return release_global(cells, k)
    children, keys = with_parents(cells, level)
    return suppress(children, keys, k)


def release_global(cells: DataFrame, k: int = K, strict: bool = True) -> DataFrame:
    """Global cells of at least k users. Not strict: smaller ones come out as ``Other`` with their counts, a leak kept for comparison."""
    rows = cells.filter(F.col("level") == GLOBAL)
    fine = F.col("users") >= k
    shown = lambda value, name: F.when(fine, value).alias(name)
    out = rows.select(
        "window_start", F.when(fine, F.lit("Visible")).otherwise(F.lit("Other")).alias("kind"), shown(F.lit(ANY), "family"), shown(F.lit(ANY), "wiki"),
        shown(F.lit(-1), "namespace"), "events", "users",
    )
    return out.filter("kind = 'Visible'") if strict else out


def suppress_single(cells: DataFrame, k: int = K) -> DataFrame:
    """Cells that stand on their own: those of at least k users."""
    return cells.filter(F.col("users") >= k)


def presented(released: DataFrame) -> DataFrame:
    """Visible rows by users, Other last."""
    return released.orderBy(F.desc("kind"), "users", "family", "wiki", "namespace")


def as_json(released: DataFrame) -> DataFrame:
    """One JSON object per row, tagged by kind; Other has no dimensions."""
    return released.select(F.to_json(F.struct("kind", "family", "wiki", "namespace", "events", "users")).alias("value"))
