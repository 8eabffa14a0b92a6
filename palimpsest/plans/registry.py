"""All queries of the core, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import building, catalog, classification, event_time, measures, retrieval

MODULES = [event_time, catalog, classification, building, retrieval, measures]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over all live repositories."""
    return retrieval.ref_q4_hybrid(spark, d)
