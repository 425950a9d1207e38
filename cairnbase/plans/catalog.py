"""Registry of the library's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pdf_queries, table_queries, text_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **vector_queries.QUERIES, **table_queries.QUERIES, **pdf_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **vector_queries.ORACLES, **table_queries.ORACLES, **pdf_queries.ORACLES}
