"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (partially aggregated) and a join; neither links nor components ever leave the
executors. Edges and minima are written to the shared folder, so a lost executor costs at most one step, and the joins
have two plain exchanges, of which Spark can split the partition of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.session import discard, materialize


def _are_stars(edges: DataFrame) -> bool:
    """Has every node one edge at most, to a node that has none? Then each star is a component."""
    heads = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    several = heads.filter("n > 1").select("u")
    inner = heads.select(F.col("v").alias("u")).distinct().join(heads.select("u"), "u")
    return several.unionByName(inner).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of undirected edges, in any order and number, to (node, root): root is the smallest node of the component.

    Nodes may have any type that can be ordered. Loops are ignored; nodes without an edge don't appear.
    """
    now = materialize(
        edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges",
    )
    while not _are_stars(now):
        # Large star: every larger neighbour of u moves to the least of u and its neighbours.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(nearest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
        # Small star: every smaller neighbour of u, and u, moves to the least of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.distinct(), "edges")
        discard(before, nearest, large, least)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
