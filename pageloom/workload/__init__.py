"""Registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

from pageloom.workload import analysis, items, jobs, pages, streams, views  # noqa: F401
from pageloom.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
