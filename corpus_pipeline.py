"""A corpus pipeline of five stages: language ID, near copies, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
``docs``. All but the last keep the columns of ``documents``, and whatever further columns there are. Nulls, empty texts
and empty tables pass as the operators define it: a text without letters goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm import op3_secrets, op6_mixing, op8_language, op9_packing, op10_jaccard
from veilstream.session import discard, materialize, shipped


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject."""
    model = op8_language.fit(docs)
    return op8_language.predict(docs, model, prefix="__language_").filter(~F.col("__language_rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return op10_jaccard.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret and every linked part of a credential replaced by a mark."""
    clean = op3_secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: each document as often as it is taken."""
    return op6_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    return op9_packing.pack(op9_packing.pieces_of(docs))


#: Each by itself brings what a query brings to a session: the package on the executors and bounded Arrow batches.
STAGES = [(stage.__name__, shipped(stage)) for stage in (language, near_copies, secrets, source_mix, packing)]

#: SQL can express neither the learned model nor the tokens; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if n:
            discard(before)  # the stage's result is written
    return docs
