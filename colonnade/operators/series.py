"""Time-bucketed measures: trends, anomalies, forecasts and cohorts.

Bucket tables are bounded by the calendar (at most one row per day of the four-digit
years), so a window over a whole bucket table is a small, bounded task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.functions.columns import aggregate, number, period_label, period_start, rounded, timestamp, value
from colonnade.functions.validate import require_columns, require_metric
from colonnade.plans.quantiles import grouped_median

SMOOTHING = 0.3


def bucketed(df: DataFrame, date: str, metric: Column, freq: str, how: str, out: str = "metric_value") -> DataFrame:
    """One row per observed bucket: (bucket date, label ``period``, aggregated metric).  Undated rows drop out."""
    frame = df.select(period_start(timestamp(df, date), freq).alias("__bucket"), metric.alias("__metric")).where(
        F.col("__bucket").isNotNull()
    )
    if how == "median":
        grouped = grouped_median(frame, ["__bucket"], F.col("__metric"), out)
    else:
        grouped = frame.groupBy("__bucket").agg(aggregate(how, F.col("__metric")).alias(out))
    return grouped.select("__bucket", period_label(F.col("__bucket"), freq).alias("period"), out)


def period_totals(df: DataFrame, date: str, metric: str, freq: str = "M", out: str | None = None) -> DataFrame:
    """Sums per bucket in time order."""
    require_columns(df, [date, metric])
    require_metric(df, metric)
    grouped = bucketed(df, date, number(df, metric), freq, "sum", out or metric)
    return grouped.drop("__bucket").orderBy("period")


def trend_analysis(
    df: DataFrame, date_column: str, metric_column: str, freq: str = "M", aggregation: str = "sum"
) -> DataFrame:
    """Metric per bucket, change against the bucket observed before, and the mean of those changes.

    The first change is null, and so is a change from a zero bucket.
    """
    require_columns(df, [date_column, metric_column])
    require_metric(df, metric_column, aggregation)
    metric = number(df, metric_column) if aggregation != "count" else value(df, metric_column)
    grouped = bucketed(df, date_column, metric, freq, aggregation)
    now, before = F.col("metric_value").cast("double"), F.lag("metric_value").over(Window.orderBy("__bucket")).cast("double")
    changed = grouped.withColumn("pct_change", F.try_divide(now - before, before) * 100)
    growth = F.coalesce(rounded(F.avg("pct_change").over(Window.partitionBy())), F.lit(0.0))
    return changed.select("period", "metric_value", "pct_change", growth.alias("average_growth_rate")).orderBy("period")


def anomaly_periods(
    df: DataFrame, date_column: str, metric_column: str, freq: str = "M", threshold: float = 1.96
) -> DataFrame:
    """Every bucket with its z-score against all buckets and whether it exceeds the threshold.

    Fewer than three buckets give no rows.
    """
    require_columns(df, [date_column, metric_column])
    require_metric(df, metric_column)
    grouped = bucketed(df, date_column, number(df, metric_column).cast("double"), freq, "sum")
    everything = Window.partitionBy()
    spread = F.stddev_samp("metric_value").over(everything)
    scored = grouped.select(
        "period",
        "metric_value",
        F.avg("metric_value").over(everything).alias("mean"),
        F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("std"),
        F.count(F.lit(1)).over(everything).alias("__periods"),
    ).where(F.col("__periods") >= 3)
    scored = scored.withColumn("z_score", (F.col("metric_value") - F.col("mean")) / F.col("std"))
    return (
        scored.withColumn("is_anomaly", F.abs("z_score") > threshold)
        .select("period", "metric_value", "z_score", "is_anomaly", "mean", "std")
        .orderBy("period")
    )


def anomaly_detection(
    df: DataFrame, date_column: str, metric_column: str, freq: str = "M", threshold: float = 1.96
) -> DataFrame:
    """Only the buckets beyond the threshold."""
    return anomaly_periods(df, date_column, metric_column, freq, threshold).where("is_anomaly").drop("is_anomaly")


def forecast_next_period(df: DataFrame, date_column: str, metric_column: str, periods: int = 3) -> DataFrame:
    """Exponential smoothing of monthly sums plus the straight-line drift, floored at zero.

    The smoothed level is a weighted sum: weight 0.7^(n-1) for the first month and
    0.3 * 0.7^(n-i) for month i.  Fewer than three months give no rows.
    """
    require_columns(df, [date_column, metric_column])
    require_metric(df, metric_column)
    months = bucketed(df, date_column, number(df, metric_column).cast("double"), "M", "sum")
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("__bucket"))
    counted = months.select("__bucket", "metric_value", place.alias("i"), F.count(F.lit(1)).over(everything).alias("n"))
    keep = 1 - SMOOTHING
    weight = F.when(F.col("i") == 1, F.pow(F.lit(keep), F.col("n") - 1)).otherwise(
        SMOOTHING * F.pow(F.lit(keep), F.col("n") - F.col("i"))
    )
    fitted = counted.agg(
        F.sum(weight * F.col("metric_value")).alias("level"),
        F.min_by("metric_value", "__bucket").alias("first"),
        F.max_by("metric_value", "__bucket").alias("last"),
        F.max("__bucket").alias("end"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= 3)
    drift = (F.col("last") - F.col("first")) / (F.col("n") - 1)
    steps = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")) if periods > 0 else fitted.select("*", F.lit(0).alias("step")).limit(0)
    return steps.select(
        period_label(F.add_months("end", F.col("step")), "M").alias("period"),
        rounded(F.greatest(F.col("level") + drift * F.col("step"), F.lit(0.0))).alias("forecast_value"),
    ).orderBy("period")


def cohort_summary(df: DataFrame, cohort_date_column: str, activity_date_column: str, user_id_column: str) -> DataFrame:
    """Distinct users per cohort and activity month, months since joining, and retention.

    Retention relates to the users active in the cohort's own month; a cohort without
    such users has a null size.
    """
    require_columns(df, [cohort_date_column, activity_date_column, user_id_column])
    dated = df.select(
        period_start(timestamp(df, cohort_date_column), "M").alias("cohort"),
        period_start(timestamp(df, activity_date_column), "M").alias("activity"),
        value(df, user_id_column).alias("user"),
    ).where(F.col("cohort").isNotNull() & F.col("activity").isNotNull() & (F.col("activity") >= F.col("cohort")))
    grouped = dated.groupBy("cohort", "activity").agg(F.countDistinct("user").alias("users"))
    size = F.max(F.when(F.col("activity") == F.col("cohort"), F.col("users"))).over(Window.partitionBy("cohort"))
    sized = grouped.withColumn("cohort_size", size)
    return sized.select(
        period_label(F.col("cohort"), "M").alias("cohort_period"),
        period_label(F.col("activity"), "M").alias("activity_period"),
        "users",
        F.months_between("activity", "cohort").cast("int").alias("cohort_lifetime"),
        "cohort_size",
        rounded(F.try_divide(F.col("users").cast("double"), F.col("cohort_size")) * 100).alias("retention_rate"),
    ).orderBy("cohort_period", "cohort_lifetime")
