"""Findings as rows: what stands out in a table, with the numbers that show it.

Each detector answers zero or more rows of one schema, in a fixed order of priority.
Sentences and cards are left to the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.columns import (
    col,
    is_numeric,
    is_positive,
    is_temporal,
    is_text,
    number,
    numeric_columns,
    ratio,
    value,
)
from colonnade.operators.metrics import compile_metric, define_metric
from colonnade.operators.quality import distinct_counts, duplicate_count
from colonnade.operators.series import bucketed
from colonnade.operators.stats import correlation_pairs, outlier_bounds
from colonnade.plans.roles import SemanticProfile, date_counts, looks_dated
from colonnade.plans.scale import materialize, with_running_sum

SCHEMA = (
    "priority int, type string, severity string, tone string, confidence double, metric string, dimension string, "
    "label string, other_label string, value double, other_value double, share double, row_count long"
)
METRIC_ROLES = ["revenue", "profit", "quantity", "salary", "cost"]
DIMENSION_ROLES = ["category", "segment", "state", "country", "department", "job_role", "campaign", "channel"]
Metrics = Sequence[Mapping[str, Any]]


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SCHEMA)


def _finding(row: DataFrame, priority: int, kind: str, confidence: float, **cells: Column | str | float | None) -> DataFrame:
    """Shape a one-row result into the finding schema; unnamed cells are null."""
    cells = {"severity": "info", "tone": "neutral", **cells}
    fixed = {"priority": priority, "type": kind, "confidence": confidence}
    out = []
    for name, kind in (field.split() for field in SCHEMA.split(", ")):
        cell = fixed.get(name, cells.get(name))
        out.append((cell if isinstance(cell, Column) else F.lit(cell)).cast(kind).alias(name))
    return row.select(*out)


def preferred_metric(df: DataFrame, profile: SemanticProfile, metrics: Metrics = ()) -> tuple[str, Column] | None:
    """First usable row-level custom metric, else the first numeric role, else the first numeric column."""
    for definition in metrics or ():
        metric = define_metric(definition)
        try:
            term = compile_metric(df, profile, metric)
        except ValueError:
            continue
        if term.per_row:
            return metric.name, term.column
    for role in METRIC_ROLES:
        column = profile.column(role)
        if column in df.columns and is_numeric(df, column):
            return role, number(df, column).cast("double")
    first = numeric_columns(df)[:1]
    return (first[0], number(df, first[0]).cast("double")) if first else None


def preferred_dimension(df: DataFrame, profile: SemanticProfile) -> tuple[str, str] | None:
    """First dimension role, else the first non-numeric column with more than one value: (name, column)."""
    for role in DIMENSION_ROLES:
        if profile.column(role) in df.columns:
            return role, profile.column(role)
    others = [c for c in df.columns if not is_numeric(df, c)]
    counts = distinct_counts(df, others) if others else {}
    return next(((c, c) for c in others if counts[c][2] > 1), None)


class Grouped(NamedTuple):
    """Sum and mean of the preferred metric by the preferred dimension (label, total, mean), materialized."""

    metric: str
    dimension: str
    table: DataFrame


def metric_by_dimension(df: DataFrame, profile: SemanticProfile, metrics: Metrics = ()) -> Grouped | None:
    """What three of the detectors look at, from one aggregation."""
    metric, dimension = preferred_metric(df, profile, metrics), preferred_dimension(df, profile)
    if metric is None or dimension is None:
        return None
    cells = df.select(value(df, dimension[1]).cast("string").alias("label"), metric[1].alias("x")).where(F.col("x").isNotNull())
    grouped = cells.groupBy("label").agg(F.sum("x").alias("total"), F.avg("x").alias("mean"))
    return Grouped(metric[0], dimension[0], materialize(grouped))


def data_quality_findings(df: DataFrame) -> DataFrame:
    """Worst column with 20 percent or more missing, duplicate rows, and constant columns (all of them are named)."""
    ordered = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(value(df, c)).alias(f"have{i}") for i, c in enumerate(df.columns)],
        *[(F.min(value(df, c)) == F.max(value(df, c))).alias(f"same{i}") for i, c in enumerate(ordered)],
    )
    gaps = F.array(
        *[
            F.struct((-(1 - ratio(F.col(f"have{i}"), F.col("rows")))).alias("gap"), F.lit(c).alias("column"))
            for i, c in enumerate(df.columns)
        ]
    )
    constant = F.array_compact(F.array(*[F.when(F.col(f"same{i}"), F.lit(c)) for i, c in enumerate(ordered)]))
    facts = row.select(F.array_min(gaps).alias("worst"), constant.alias("constant"))
    worst = F.col("worst")
    missing = _finding(
        facts.where(-worst["gap"] >= 0.2), 10, "data_quality", 0.9,
        severity="warning", tone="risk", dimension=worst["column"], label="missing", value=-worst["gap"],
    )
    repeats = duplicate_count(df).where(F.col("duplicate_rows") > 0)
    duplicates = _finding(
        repeats, 11, "data_quality", 0.86, severity="warning", tone="risk", label="duplicates",
        value=F.col("duplicate_rows"), share=ratio(F.col("duplicate_rows"), F.col("rows")),
    )
    constants = _finding(
        facts.where(F.size("constant") > 0), 12, "data_quality", 0.8, label="constant",
        dimension=F.array_join("constant", ", "), value=F.size("constant"),
    )
    return missing.unionByName(duplicates).unionByName(constants)


def top_contributor_finding(df: DataFrame, profile: SemanticProfile, metrics: Metrics = (), grouped: Grouped | None = None) -> DataFrame:
    """The group with the largest sum, and its share of all."""
    found = grouped or metric_by_dimension(df, profile, metrics)
    if found is None:
        return _none(df)
    metric, dimension, sums = found
    best = sums.agg(
        F.min(F.struct((-F.col("total")).alias("total"), "label")).alias("best"), F.sum("total").alias("all")
    ).where(F.col("best").isNotNull())
    top = -F.col("best")["total"]
    return _finding(
        best, 20, "top_contributor", 0.84, tone="positive", metric=metric, dimension=dimension,
        label=F.col("best")["label"], value=top, share=ratio(top, F.col("all")),
    )


def trend_finding(df: DataFrame, profile: SemanticProfile, metrics: Metrics = ()) -> DataFrame:
    """Last month against the first one."""
    metric, date = preferred_metric(df, profile, metrics), profile.column("date") or _first_date_column(df)
    if metric is None or not date:
        return _none(df)
    rows = df.where(metric[1].isNotNull())
    months = bucketed(rows, date, metric[1], "M", "sum")
    ends = months.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("metric_value", "__bucket").alias("first"),
        F.max_by("metric_value", "__bucket").alias("last"),
        F.min_by("period", "__bucket").alias("first_period"),
        F.max_by("period", "__bucket").alias("last_period"),
    ).where(F.col("n") >= 2)
    change = F.col("last") - F.col("first")
    return _finding(
        ends, 30, "trend", 0.78,
        severity=F.when(change >= 0, "info").otherwise("warning"), tone=F.when(change >= 0, "positive").otherwise("risk"),
        metric=metric[0], dimension="date", label=F.col("last_period"), other_label=F.col("first_period"),
        value=F.col("last"), other_value=F.col("first"), share=ratio(change, F.abs("first")),
    )


def _first_date_column(df: DataFrame) -> str | None:
    """First column of dates, or of texts named like dates and read as such in most cells."""
    named = [c for c in df.columns if is_text(df, c) and ("date" in c.lower() or "time" in c.lower())]
    read = {}
    if named:
        aggs = [F.struct(F.count(col(c)).alias("n"), *[x.alias(t) for t, x in zip("pd", date_counts(df, c))]).alias(f"c{i}") for i, c in enumerate(named)]
        row = df.agg(*aggs).select(*[looks_dated(F.col(f"c{i}.n"), F.col(f"c{i}.p"), F.col(f"c{i}.d")) for i in range(len(named))]).first()
        read = dict(zip(named, row))
    return next((c for c in df.columns if is_temporal(df, c) or read.get(c)), None)


def outlier_finding(df: DataFrame) -> DataFrame:
    """First numeric column with values beyond the quartile fences."""
    names = numeric_columns(df)
    if not names:
        return _none(df)
    fences = outlier_bounds(df, names)
    aggs = []
    for i, name in enumerate(names):
        x = number(df, name).cast("double")
        low, high = fences[name]
        aggs += [F.count(x).alias(f"n{i}"), F.count_if((x < low) | (x > high)).alias(f"out{i}")]
    row = df.agg(*aggs)
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(f"n{i}") >= 4) & (fences[c][1] > fences[c][0]) & (F.col(f"out{i}") > 0),
                    F.struct(
                        F.lit(c).alias("column"), F.col(f"out{i}").alias("n"), fences[c][0].alias("low"), fences[c][1].alias("high")
                    ),
                )
                for i, c in enumerate(names)
            ]
        )
    )
    first = row.select(F.get(hits, F.lit(0)).alias("hit")).where(F.col("hit").isNotNull())
    hit = F.col("hit")
    return _finding(
        first, 40, "outlier", 0.76, severity="warning", tone="risk", metric=hit["column"],
        value=hit["low"], other_value=hit["high"], row_count=hit["n"],
    )


def segment_gap_finding(df: DataFrame, profile: SemanticProfile, metrics: Metrics = (), grouped: Grouped | None = None) -> DataFrame:
    """Groups with the highest and the lowest mean."""
    found = grouped or metric_by_dimension(df, profile, metrics)
    if found is None:
        return _none(df)
    metric, dimension, sums = found
    ends = sums.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct((-F.col("mean")).alias("mean"), "label")).alias("top"),
        F.min(F.struct("mean", "label")).alias("bottom"),
    )
    top, bottom = -F.col("top")["mean"], F.col("bottom")["mean"]
    return _finding(
        ends.where((F.col("n") >= 2) & (top != bottom)), 50, "segment_difference", 0.75, metric=metric, dimension=dimension,
        label=F.col("top")["label"], other_label=F.col("bottom")["label"], value=top, other_value=bottom,
    )


def correlation_finding(df: DataFrame) -> DataFrame:
    """Strongest pair of numeric columns, from 0.5 on."""
    names = sorted(numeric_columns(df))
    if len(names) < 2:
        return _none(df)
    pairs = correlation_pairs(df, names).where(F.col("column_a") != F.col("column_b"))
    best = pairs.where(F.abs("correlation") >= 0.5).orderBy(F.abs("correlation").desc(), "column_a", "column_b").limit(1)
    return _finding(
        best, 60, "correlation", 0.72, metric=F.col("column_a"), dimension=F.col("column_b"), value=F.col("correlation")
    )


def concentration_finding(df: DataFrame, profile: SemanticProfile, metrics: Metrics = (), grouped: Grouped | None = None) -> DataFrame:
    """How many of the largest groups together stay within 80 percent of the total."""
    found = grouped or metric_by_dimension(df, profile, metrics)
    if found is None:
        return _none(df)
    metric, dimension, sums = found
    running = with_running_sum(sums, [F.desc("total"), F.asc_nulls_last("label")], F.col("total"), "upto")
    grand = sums.agg(F.sum("total").alias("x")).scalar()
    counted = running.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.try_divide(F.col("upto"), grand) <= 0.8).alias("within"),
        F.sum("total").alias("all"),
    ).where((F.col("groups") >= 3) & (F.col("all") != 0))
    few = F.greatest(F.col("within"), F.lit(1))
    return _finding(
        counted, 70, "pareto", 0.74, metric=metric, dimension=dimension, value=few,
        share=ratio(few, F.col("groups")), row_count=F.col("groups"),
    )


def target_finding(df: DataFrame, profile: SemanticProfile) -> DataFrame:
    """The group with the highest rate of positive outcomes."""
    target, dimension = profile.column("target", "conversion"), preferred_dimension(df, profile)
    if not target or dimension is None:
        return _none(df)
    cells = df.select(
        value(df, dimension[1]).cast("string").alias("label"),
        value(df, target).alias("target"),
        is_positive(df, target, "insight").cast("int").alias("hit"),
    )
    rates = cells.groupBy("label").agg(F.count("target").alias("rows"), F.avg("hit").alias("rate")).where(F.col("rows") >= 1)
    best = rates.orderBy(F.desc("rate"), F.asc_nulls_last("label")).limit(1)
    return _finding(
        best, 80, "target_conversion", 0.78, tone="positive", metric=target, dimension=dimension[0],
        label=F.col("label"), value=F.col("rate"), row_count=F.col("rows"),
    )


def generate_insights(
    df: DataFrame, profile: SemanticProfile, metrics: Metrics = (), max_insights: int | None = 10
) -> DataFrame:
    """All findings in priority order, at most ``max_insights`` (None: all)."""
    grouped = metric_by_dimension(df, profile, metrics)
    shared = [] if grouped is None else [
        top_contributor_finding(df, profile, metrics, grouped),
        segment_gap_finding(df, profile, metrics, grouped),
        concentration_finding(df, profile, metrics, grouped),
    ]
    parts = [
        data_quality_findings(df),
        *shared,
        trend_finding(df, profile, metrics),
        outlier_finding(df),
        correlation_finding(df),
        target_finding(df, profile),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    ordered = result.orderBy("priority")
    return ordered if max_insights is None else ordered.limit(max_insights)
