"""All queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_comparison, q_events, q_market, q_phrases, q_relational, q_targets, q_text, q_universe, q_vectors

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (q_targets, q_vectors, q_text, q_phrases, q_relational, q_market, q_events, q_comparison, q_universe)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, (_, sql) in m.QUERIES.items() if sql}
