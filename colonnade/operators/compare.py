"""Two segments or two periods side by side, each from one conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import aggregate, col, in_range, number, percent, rounded, value
from colonnade.functions.validate import require_columns, require_metric
from colonnade.plans.measures import overall_measures, scalar_of
from colonnade.plans.quantiles import grouped_median


def _metric(df: DataFrame, name: str, aggregation: str) -> Column:
    return value(df, name) if aggregation == "count" else number(df, name)


def _sides(df: DataFrame, metric: Column, in_a: Column, in_b: Column, how: str) -> DataFrame:
    """One row (value_a, value_b); a side without values is 0.0."""
    sides = overall_measures(df, {"value_a": F.when(in_a, metric), "value_b": F.when(in_b, metric)}, how)
    return sides.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in ("value_a", "value_b")])


def compare_segments(
    df: DataFrame, segment_column: str, segment_a: str, segment_b: str, metric_column: str, aggregation: str = "mean"
) -> DataFrame:
    """One row: the metric of two segments, their difference and a sentence about it."""
    require_columns(df, [segment_column, metric_column])
    require_metric(df, metric_column, aggregation)
    segment = value(df, segment_column)
    chosen = df.where(segment.isin(segment_a, segment_b))
    sides = _sides(
        chosen, _metric(df, metric_column, aggregation), segment == F.lit(segment_a), segment == F.lit(segment_b), aggregation
    )
    gap = F.col("value_a") - F.col("value_b")
    share = F.coalesce(F.try_divide(gap, F.col("value_b")) * 100, F.lit(0.0))
    text = F.concat(
        F.lit(f"Segment '{segment_a}' is "),
        rounded(F.abs(share)).cast("string"),
        F.when(gap > 0, F.lit("% higher than ")).otherwise(F.lit("% lower than ")),
        F.lit(f"'{segment_b}'"),
    )
    return sides.select(
        F.lit(segment_column).alias("segment_column"),
        F.lit(segment_a).alias("segment_a"),
        F.lit(segment_b).alias("segment_b"),
        F.lit(metric_column).alias("metric_column"),
        F.lit(aggregation).alias("aggregation"),
        "value_a",
        "value_b",
        gap.alias("absolute_difference"),
        rounded(share).alias("percentage_difference"),
        text.alias("conclusion"),
    )


def period_over_period_change(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    period_a_start: str,
    period_a_end: str,
    period_b_start: str,
    period_b_end: str,
    aggregation: str = "sum",
) -> DataFrame:
    """One row: the metric in two closed ranges and the change from b to a."""
    require_columns(df, [date_column, metric_column])
    require_metric(df, metric_column, aggregation)
    in_a = in_range(df, date_column, period_a_start, period_a_end)
    in_b = in_range(df, date_column, period_b_start, period_b_end)
    sides = _sides(df.where(in_a | in_b), _metric(df, metric_column, aggregation), in_a, in_b, aggregation)
    gap = F.col("value_a") - F.col("value_b")
    return sides.select(
        F.lit(date_column).alias("date_column"),
        F.lit(metric_column).alias("metric_column"),
        F.lit(period_a_start).alias("period_a_start"),
        F.lit(period_a_end).alias("period_a_end"),
        "value_a",
        F.lit(period_b_start).alias("period_b_start"),
        F.lit(period_b_end).alias("period_b_end"),
        "value_b",
        gap.alias("absolute_difference"),
        percent(gap, F.col("value_b")).alias("percentage_difference"),
    )


def _changes(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    dimension_column: str,
    bounds: tuple[str, str, str, str],
    aggregation: str,
) -> DataFrame:
    """Per dimension value: the metric in both ranges, 0.0 where there is none, and the difference."""
    require_columns(df, [date_column, metric_column, dimension_column])
    require_metric(df, metric_column, aggregation)
    a_start, a_end, b_start, b_end = bounds
    in_a, in_b = in_range(df, date_column, a_start, a_end), in_range(df, date_column, b_start, b_end)
    metric = _metric(df, metric_column, aggregation)
    frame = df.where(in_a | in_b).select(
        value(df, dimension_column).alias("__dim"), F.when(in_a, metric).alias("__a"), F.when(in_b, metric).alias("__b")
    )
    if aggregation == "median":
        left = grouped_median(frame, ["__dim"], F.col("__a"), "a")
        right = grouped_median(frame, ["__dim"], F.col("__b"), "b").withColumnRenamed("__dim", "__dim_b")
        grouped = left.join(right, F.col("__dim").eqNullSafe(F.col("__dim_b")), "left").drop("__dim_b")
    else:
        grouped = frame.groupBy("__dim").agg(
            aggregate(aggregation, F.col("__a")).alias("a"), aggregate(aggregation, F.col("__b")).alias("b")
        )
    a, b = (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in ("a", "b"))
    return grouped.select(
        F.col("__dim").cast("string").alias("dimension_value"),
        a.alias("value_period_a"),
        b.alias("value_period_b"),
        (a - b).alias("absolute_change"),
    )


def explain_metric_change(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    dimension_column: str,
    period_a_start: str,
    period_a_end: str,
    period_b_start: str,
    period_b_end: str,
    aggregation: str = "sum",
) -> DataFrame:
    """Change between two ranges per dimension value, with its share of the whole change, largest first."""
    bounds = (period_a_start, period_a_end, period_b_start, period_b_end)
    changes = _changes(df, date_column, metric_column, dimension_column, bounds, aggregation)
    whole = scalar_of(changes, F.sum("absolute_change").alias("change"))
    return changes.withColumn("contribution_to_change_percent", percent(F.col("absolute_change"), whole["change"])).orderBy(
        F.abs("absolute_change").desc(), F.asc_nulls_last("dimension_value")
    )


def explain_metric_change_totals(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    dimension_column: str,
    period_a_start: str,
    period_a_end: str,
    period_b_start: str,
    period_b_end: str,
    aggregation: str = "sum",
) -> DataFrame:
    """One row: both totals over the dimension values, their difference and percent."""
    bounds = (period_a_start, period_a_end, period_b_start, period_b_end)
    changes = _changes(df, date_column, metric_column, dimension_column, bounds, aggregation)
    totals = changes.agg(
        F.coalesce(F.sum("value_period_a"), F.lit(0.0)).alias("period_a_total"),
        F.coalesce(F.sum("value_period_b"), F.lit(0.0)).alias("period_b_total"),
    )
    gap = F.col("period_a_total") - F.col("period_b_total")
    return totals.select(
        "period_a_total",
        "period_b_total",
        gap.alias("absolute_change"),
        percent(gap, F.col("period_b_total")).alias("percentage_change"),
    )
