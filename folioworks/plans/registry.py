"""All queries of the core by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioworks.plans import grounding_queries, record_queries, scene_queries, text_queries

_MODULES = (grounding_queries, text_queries, scene_queries, record_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
