"""Registered queries of the retrieval and corpus operators."""

from . import ops_queries, report_queries, retrieval_queries, state_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
