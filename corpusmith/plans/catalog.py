"""All queries of the core with their SQL."""

from __future__ import annotations

from corpusmith.plans import fact_queries, model_queries, more_queries, series_queries, text_queries  # noqa: F401
from corpusmith.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
