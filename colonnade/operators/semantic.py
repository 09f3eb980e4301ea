"""Operators that find their columns through a semantic profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.columns import col, is_numeric, is_positive, number, rounded, summand, total, value
from colonnade.functions.validate import at_most
from colonnade.operators.series import period_totals
from colonnade.plans.measures import exact_total
from colonnade.plans.roles import SemanticProfile


def notice(spark: SparkSession, *texts: str) -> DataFrame:
    """What an operator answers when the roles it needs are missing: its warnings, or no rows."""
    return spark.createDataFrame([(t,) for t in texts], "warning string")


def semantic_overview(df: DataFrame, profile: SemanticProfile) -> DataFrame:
    """One row: domain, shape, roles and warnings."""
    roles = [F.struct(F.lit(r).alias("role"), F.lit(m.column).alias("column")) for r, m in profile.roles.items()]
    texts = F.array(*[F.lit(w) for w in profile.warnings]).cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(profile.domain).alias("domain"),
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.array(*roles).cast("array<struct<role:string,column:string>>").alias("roles"),
        texts.alias("warnings"),
    )


def semantic_kpis(df: DataFrame, profile: SemanticProfile) -> DataFrame:
    """One row: sums of the money and quantity roles that exist, and the positive target rate."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")]
    summed = [
        role
        for role in ("revenue", "profit", "cost", "quantity", "salary")
        if profile.column(role) and is_numeric(df, profile.column(role))
    ]
    aggs += [total(number(df, profile.column(role))).alias(role) for role in summed]
    target = profile.column("target", "conversion")
    if target:
        aggs.append(F.coalesce(F.avg(is_positive(df, target).cast("int")), F.lit(0.0)).alias("target_rate"))
    lacking = "revenue" not in summed and profile.domain in ("retail", "ecommerce", "finance")
    texts = ["Revenue role is missing or non-numeric."] if lacking else []
    return df.agg(*aggs).withColumn("warnings", F.array(*[F.lit(t) for t in texts]).cast("array<string>"))


def semantic_time_series(df: DataFrame, profile: SemanticProfile, metric_role: str | None = None) -> DataFrame:
    """Monthly sums of the asked role, or of revenue, profit or quantity when it is not numeric."""
    date = profile.column("date")
    asked = profile.column(metric_role) if metric_role else None
    metric = asked if asked and is_numeric(df, asked) else profile.column("revenue", "profit", "quantity")
    if not date or not metric or not is_numeric(df, metric):
        return df.sparkSession.createDataFrame([], "period string, metric_value double")
    return period_totals(df, date, metric)


def semantic_breakdown(
    df: DataFrame, profile: SemanticProfile, by_role: str, metric_role: str = "revenue", limit: int | None = 20
) -> DataFrame:
    """Sum of one role by another, largest groups first; sums of whole numbers are exact, as decimal(38,0)."""
    by, metric = profile.column(by_role), profile.column(metric_role)
    if not by or not metric or not is_numeric(df, metric):
        return notice(df.sparkSession)
    keyed = df.select(value(df, by).alias("__key"), summand(df, metric).alias("__metric"))
    sums = keyed.groupBy(F.col("__key").alias(by)).agg(exact_total(keyed, "__metric").alias(metric if metric != by else f"sum_{metric}"))
    return at_most(sums.orderBy(F.col(f"`{sums.columns[1]}`").desc_nulls_last(), col(by).asc_nulls_last()), limit)


def semantic_target_rate(df: DataFrame, profile: SemanticProfile) -> DataFrame:
    """One row: target column and the rate of positive outcomes over all rows."""
    target = profile.column("target", "conversion")
    if not target:
        return notice(df.sparkSession, "No target/conversion column detected.")
    rate = F.coalesce(F.avg(is_positive(df, target).cast("int")), F.lit(0.0))
    return df.agg(F.lit(target).alias("target_column"), rate.alias("positive_rate"))


def semantic_target_summary(
    df: DataFrame, profile: SemanticProfile, by_role: str | None = None, limit: int | None = 20
) -> DataFrame:
    """Positive rate by group, highest first; without a group role, the overall rate.

    ``rows`` counts rows with a target, the rate relates to all rows of the group.
    The group may be the target column itself.
    """
    target = profile.column("target", "conversion")
    by = profile.column(by_role) if by_role else None
    if not target or not by:
        return semantic_target_rate(df, profile)
    frame = df.select(
        value(df, by).alias(by), value(df, target).alias("__target"), is_positive(df, target).cast("int").alias("__positive")
    )
    grouped = frame.groupBy(col(by)).agg(F.count("__target").alias("rows"), F.avg("__positive").alias("positive_rate"))
    return at_most(grouped.orderBy(F.desc("positive_rate"), col(by).asc_nulls_last()), limit)
