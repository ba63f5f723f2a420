"""Registered queries: each runs an operator over whole tables."""
from .registry import COVERS, ORACLES, QUERIES
from . import (book_queries, capture_queries, comp_queries, guide_queries, listing_queries, pool_queries,
               report_queries, source_queries, text_queries, value_queries)  # noqa: F401

__all__ = ["COVERS", "ORACLES", "QUERIES"]
