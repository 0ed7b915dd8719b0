"""Importing this module registers every query."""

from __future__ import annotations

from workload import ingest_queries, merge_queries, ranking_queries, rating_queries  # noqa: F401
from workload.registry import ORACLE, QUERIES  # noqa: F401
