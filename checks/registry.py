"""Name -> (Spark query, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SparkQuery = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, SparkQuery] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[SparkQuery], SparkQuery]:
    """Register a query under its function name."""

    def register(fn: SparkQuery) -> SparkQuery:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def iso(column: str) -> str:
    """DuckDB text of a UTC timestamp in ISO 8601 with offset."""
    fraction = f"CASE WHEN strftime({column},'%f')='000000' THEN '' ELSE '.'||strftime({column},'%f') END"
    return f"strftime({column},'%Y-%m-%dT%H:%M:%S')||{fraction}||'+00:00'"
