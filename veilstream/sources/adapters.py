"""Events from the driver's tables: ``events`` itself, and the orders star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the ``events`` table: families are event types, wikis and namespaces come from props.k."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user"), "ts", F.col("event_type").alias("family"),
        F.concat_ws("-", "event_type", (k % 5).cast("string")).alias("wiki"), (F.floor(k / 5) % 3).cast("int").alias("namespace"), "value",
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the orders star: a customer's order in a region (family), nation (wiki) and market segment (namespace)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # 25 nations and 5 regions, whatever the scale
    places = F.broadcast(table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    number = F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("c_mktsegment")).cast("int") - 1
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.col("c_name").alias("user"), F.col("o_orderdate").alias("ts"),
        F.col("r_name").alias("family"), F.col("n_name").alias("wiki"), number.alias("namespace"), F.col("o_totalprice").alias("value"),
    )
