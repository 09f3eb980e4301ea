"""Eager checks on names, types and arguments, made before a plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from colonnade.functions.columns import AGGREGATIONS, is_numeric


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    present = set(df.columns)
    absent = [name for name in names if name not in present]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")


def require_metric(df: DataFrame, metric: str, aggregation: str = "sum") -> None:
    """A metric must be numeric unless it is only counted."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"Unsupported aggregation: {aggregation}.")
    if aggregation != "count" and not is_numeric(df, metric):
        raise ValueError(f"Metric column '{metric}' must be numeric for aggregation '{aggregation}'.")


def require_limit(value: int | None, upper: int, name: str = "limit") -> None:
    """A limit within its bounds; None stands for all rows."""
    if value is not None and not 1 <= value <= upper:
        raise ValueError(f"{name} must be between 1 and {upper}.")


def at_most(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; None stands for all."""
    return df if limit is None else df.limit(limit)
