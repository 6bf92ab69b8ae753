"""All queries over the sample tables, by name."""

from . import live_queries, review_queries, stream_queries, trajectory_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
