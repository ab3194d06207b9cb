"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.plans import connectors, documents, evaluation, further, relational, streams

MODULES = (relational, evaluation, documents, streams, further, connectors)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = "flagship_source_profile"
