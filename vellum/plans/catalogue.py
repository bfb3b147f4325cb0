"""Every registered query with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import agendas, contents, reader, sources, texts, users

FLAGSHIP = "eligibility"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (agendas, texts, contents, users, reader, sources):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
