"""Operators of a training-data pipeline and their registered queries."""

from __future__ import annotations

from veilstream.llm import op1_sharding, op2_topk, op3_secrets, op4_license, op5_chat, op6_mixing, op7_jpeg, op8_language, op9_packing, op10_jaccard

#: Modules that register a query, in order.
MODULES = [op1_sharding, op2_topk, op3_secrets, op4_license, op5_chat, op6_mixing, op7_jpeg, op8_language, op9_packing, op10_jaccard]


def queries() -> dict:
    """Name to callable for every operator of this subpackage and the pipeline."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    """DuckDB SQL of the queries that SQL can express."""
    return {k: q for m in MODULES for k, q in getattr(m, "ORACLES", {}).items()}
