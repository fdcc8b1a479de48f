"""Queries that apply the operators to the driver's tables."""

from tessella.plans import assistant, content, crawling, exploration, frontiers, grounding, knowledge, operations, pages, payloads, publishing, relational, reviewing  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
