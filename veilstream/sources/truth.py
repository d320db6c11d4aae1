"""Ground truth as one pretty JSON document, as a load generator leaves it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.plans.model import TRUTH


def write_truth(cells: DataFrame, path: str) -> None:
    """Write cells as {"cells": [...]}, one file. For generated truth, whose size is the generator's."""
    names = [f.name for f in TRUTH["cells"].dataType.elementType.fields]
    one = cells.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("cells"))
    one.select(F.to_json(F.struct("cells"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a truth file."""
    return spark.read.schema(TRUTH).json(path, multiLine=True).select(F.inline("cells"))
