"""All registered queries of the engine."""

from __future__ import annotations

from factloom.plans import fact_queries, history_queries, operator_queries  # noqa: F401  (they register on import)
from factloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
