"""All registered queries of the document operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import document_queries, layout_queries, ocr_queries, raster_queries, table_queries, text_queries

MODULES = (text_queries, layout_queries, table_queries, ocr_queries, raster_queries, document_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = document_queries.document_blocks
