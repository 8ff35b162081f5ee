"""Names of the queries over the driver's tables."""

from __future__ import annotations

from coppice.plans import api_queries  # noqa: F401  registers its queries
from coppice.plans.tree_queries import ORACLE_SQL, QUERIES

ENTRY = "optimal_tree_depth2"

__all__ = ["ENTRY", "ORACLE_SQL", "QUERIES"]
