"""All queries of the engine: importing the modules registers them."""

from graphloom.plans import analysis_queries, history_queries, index_queries, search_queries, stream_queries  # noqa: F401
from graphloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
