"""The data behind the chart kinds; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col, number, total, value
from colonnade.functions.validate import require_columns
from colonnade.operators.series import bucketed
from colonnade.operators.stats import box_summary, histogram

#: Bars of a chart unless the caller says otherwise; None is all.
BARS = 20


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def bar_count(df: DataFrame, x: str, limit: int | None = BARS) -> DataFrame:
    """Most frequent values, null left out."""
    require_columns(df, [x])
    counts = df.where(value(df, x).isNotNull()).groupBy(col(x)).agg(F.count(F.lit(1)).alias("count"))
    return _first(counts.orderBy(F.desc("count"), col(x).asc()), limit)


def bar_sum(df: DataFrame, x: str, y: str, limit: int | None = BARS) -> DataFrame:
    """Largest sums by value, null kept as a value."""
    require_columns(df, [x, y])
    keyed = df.select(value(df, x).alias("__x"), number(df, y).alias("__y"))
    sums = keyed.groupBy(F.col("__x").alias(x)).agg(total(F.col("__y")).alias(y if y != x else f"sum_{y}"))
    return _first(sums.orderBy(col(sums.columns[1]).desc(), col(x).asc_nulls_last()), limit)


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Monthly sums."""
    require_columns(df, [x, y])
    months = bucketed(df, x, number(df, y), "M", "sum", y)
    return months.select(F.col("period").alias(x), col(y)).orderBy(col(x))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    require_columns(df, [x, y])
    return df.select(col(x), col(y))


def chart_data(df: DataFrame, chart_type: str, x: str, y: str | None = None, bins: int = 50, limit: int | None = BARS) -> DataFrame:
    """Rows for a bar, line, scatter, histogram or box chart."""
    require_columns(df, [x, *([y] if y else [])])
    if chart_type in ("line", "scatter") and y is None:
        raise ValueError(f"{chart_type.title()} chart requires y column.")
    if chart_type == "bar":
        return bar_sum(df, x, y, limit) if y else bar_count(df, x, limit)
    if chart_type == "line":
        return line(df, x, y)
    if chart_type == "scatter":
        return scatter(df, x, y)
    if chart_type == "histogram":
        return histogram(df, x, bins)
    if chart_type == "box":
        return box_summary(df, x)
    raise ValueError(f"Unsupported chart type: {chart_type}")
