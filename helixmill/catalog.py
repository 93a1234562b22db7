"""Queries of the amplicon engine with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import calling_queries, graph_queries, interval_queries, kernel_queries, read_queries, score_queries, seed_queries, walk_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
