"""Importing the package registers every query."""

from archspark.queries import enrichment, extract, graph, history, quality, score, scorecard  # noqa: F401
from archspark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
