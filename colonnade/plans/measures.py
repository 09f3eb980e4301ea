"""Aggregations chosen by name, per group or overall, with an exact distributed median."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.columns import aggregate, col, is_whole_decimal, total
from colonnade.plans.quantiles import exact_quantiles, grouped_median


def exact_total(frame: DataFrame, name: str, whole_as: str = "decimal(38,0)") -> Column:
    """The sum of a column, 0 without values: exact for whole numbers, whatever they add up to, else a double."""
    kind = frame.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.sum(col(name).cast("decimal(20,0)")), F.lit(0)).cast(whole_as)
    if is_whole_decimal(kind):
        return F.coalesce(F.sum(col(name)), F.lit(0)).cast(whole_as)
    return total(col(name))


def grouped_measure(df: DataFrame, keys: Mapping[str, Column], metric: Column, how: str, out: str) -> DataFrame:
    """One row per key with ``how`` applied to ``metric``; sums of whole numbers are exact, as decimal(38,0)."""
    frame = df.select(*[c.alias(name) for name, c in keys.items()], metric.alias("__metric"))
    if how == "median":
        return grouped_median(frame, list(keys), F.col("__metric"), out)
    measure = exact_total(frame, "__metric") if how == "sum" else aggregate(how, F.col("__metric"))
    return frame.groupBy(*[col(k) for k in keys]).agg(measure.alias(out))


def overall_measures(df: DataFrame, metrics: Mapping[str, Column], how: str) -> DataFrame:
    """One row with ``how`` applied to every metric, in one pass."""
    frame = df.select(*[c.alias(name) for name, c in metrics.items()])
    if how == "median":
        middles = exact_quantiles(frame, {name: [0.5] for name in metrics})
        return df.sparkSession.range(1).select(
            *[F.lit(middles[name][0]).cast("double").alias(name) for name in metrics]
        )
    return frame.agg(*[aggregate(how, col(name)).alias(name) for name in metrics])


def scalar_of(df: DataFrame, *aggs: Column) -> Column:
    """A one-row aggregate as a scalar subquery: a struct column usable in any plan.

    Spark runs it once, before the main plan, and reuses a shuffle the two share.
    """
    return df.agg(*aggs).select(F.struct("*")).scalar()
