"""Imports every query module so their registrations run; exposes the registry."""

from __future__ import annotations

from . import (block_queries, classify_queries, mention_queries, search_queries, sentiment_queries,  # noqa: F401
               source_queries, spelling_queries, stream_queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
