"""Every named query, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import documents_json, events, generated, insurance, learning, logs, order_quality, people, relations, retail, scalars, spatial, streams

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retail, insurance, order_quality, people, spatial, events, documents_json, logs, relations, scalars, learning, generated, streams)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
