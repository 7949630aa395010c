"""Complete plans built from the operators, each registered as a named query."""

from lattica.plans import catalog, extraction, graph_queries, maintenance, operations, retrieval  # noqa: F401
from lattica.plans.registry import QUERIES

__all__ = ["QUERIES"]
