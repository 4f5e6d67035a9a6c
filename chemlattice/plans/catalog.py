"""Registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chemlattice.plans import chemistry, ingest, searches, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (searches, chemistry, storage, ingest):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
