"""Named queries over the driver's tables, each with the SQL it should agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the DuckDB text with the same result."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def load() -> None:
    from catalogue import cleaning, domains, generic, matching, preparing, profiling, sales  # noqa: F401, I001
    from catalogue import dashboards  # noqa: F401  (uses the SQL of the others)
