"""All queries of this package and their SQL."""

from __future__ import annotations

from . import data_queries, metric_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
