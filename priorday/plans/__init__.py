"""Registered queries and the SQL that must give the same rows."""

from . import market_queries, match_queries, score_queries, source_queries  # noqa: F401  they register
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
