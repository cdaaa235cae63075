"""All registered queries."""

from __future__ import annotations

from . import metric_queries, source_queries, store_queries  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES

flagship = store_queries.ingest_pipeline

__all__ = ["ORACLE", "QUERIES", "flagship"]
