"""Expected against actual numbers, and summaries of check runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col, is_numeric, number, rounded
from colonnade.operators.quality import duplicate_count
from colonnade.operators.semantic import semantic_breakdown, semantic_target_summary, semantic_time_series
from colonnade.operators.stats import detect_outliers
from colonnade.plans.quantiles import exact_quantiles
from colonnade.plans.roles import SemanticProfile
from colonnade.plans.scale import read_repeatedly

# What a run has to reach.
THRESHOLDS = {
    "domain_accuracy": 0.80,
    "role_mapping_accuracy": 0.75,
    "intent_accuracy": 0.80,
    "tool_accuracy": 0.80,
    "numeric_accuracy": 0.90,
    "error_rate_max": 0.05,
}
EXPECTED_SCHEMA = "case_id string, label string, metric string, expected double, tolerance double"
TOLERANCE = 0.01
# Tools that read what another one reads.
SAME_READING = {"groupby_aggregate": "semantic_breakdown", "top_bottom_contributors": "semantic_breakdown", "trend_analysis": "semantic_time_series"}
RATE_TOLERANCE = 0.000001


def check_join(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("dataset", "label", "metric")) -> DataFrame:
    """Join expectations to results and test ``actual`` within relative or absolute tolerance.

    An expectation without a result fails.  Keys are compared as trimmed lower-case text,
    null keys match null keys.
    """

    def plain(name: str) -> Column:
        return F.lower(F.trim(F.col(name).cast("string")))

    left = expected.select(*[plain(k).alias(k) for k in keys], F.col("expected").cast("double"), F.col("tolerance").cast("double"))
    right = actual.select(*[plain(k).alias(f"__{k}") for k in keys], F.col("actual").cast("double").alias("actual"))
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = equal if same is None else same & equal
    e, a, t = F.col("expected"), F.col("actual"), F.col("tolerance")
    close = F.abs(a - e) <= F.greatest(t * F.greatest(F.abs(a), F.abs(e)), t)
    return left.join(right, same, "left").select(*keys, "expected", "actual", "tolerance", F.coalesce(close, F.lit(False)).alias("passed"))


def expected_values(df: DataFrame, profile: SemanticProfile, cases: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The number each case should produce, from the operator the case names.

    A case has ``id``, ``tool`` and maybe ``metric_role`` and ``dimension_role``.  The columns that the cases
    name are held while they are read, so ``df`` is computed once for all of them; only a case on whole rows
    reads ``df`` itself.  The result, one row a case at most, is computed at once.
    """
    named = {c for case in cases for c in _columns(profile, case)}
    with read_repeatedly(df.select(*[col(c) for c in df.columns if c in named])) as held:
        source = lambda case: df if case["tool"] == "get_duplicate_rows" else held
        parts = [p for p in (_expected(source(case), profile, case) for case in cases) if p is not None]
        found = reduce(DataFrame.unionByName, parts).collect() if parts else []
    return df.sparkSession.createDataFrame(found, EXPECTED_SCHEMA)


def _columns(profile: SemanticProfile, case: Mapping[str, Any]) -> list[str]:
    """The columns that :func:`_expected` reads for a case, whole rows aside."""
    tool, metric, by = case["tool"], case.get("metric_role") or "", case.get("dimension_role") or ""
    if tool in ("get_sales_overview", "top_skus_by_revenue"):
        return ["revenue", "sku"]
    found = {
        "semantic_breakdown": [profile.column(metric), profile.column(by)],
        "semantic_time_series": [profile.column(metric, "revenue", "profit", "quantity"), profile.column("date")],
        "semantic_target_summary": [profile.column("target", "conversion"), profile.column(by)],
        "detect_outliers": [profile.column(metric, "quantity", "revenue")],
    }
    return [c for c in found.get(SAME_READING.get(tool, tool), []) if c]


def _row(source: DataFrame, case: Mapping[str, Any], label: Column, metric: str, value: Column, tolerance: float) -> DataFrame:
    return source.select(
        F.lit(str(case["id"])).alias("case_id"),
        label.cast("string").alias("label"),
        F.lit(metric).alias("metric"),
        F.round(value.cast("double"), 6).alias("expected"),
        F.lit(tolerance).alias("tolerance"),
    )


def _expected(df: DataFrame, profile: SemanticProfile, case: Mapping[str, Any]) -> DataFrame | None:
    tool, metric_role, by_role = case["tool"], case.get("metric_role"), case.get("dimension_role")
    nothing = F.lit(None)
    if tool in ("semantic_breakdown", "groupby_aggregate", "top_bottom_contributors"):
        metric, by = profile.column(metric_role or ""), profile.column(by_role or "")
        if not metric or not by or not is_numeric(df, metric):
            return None
        top = semantic_breakdown(df, profile, by_role, metric_role, 1).toDF("label", "value")
        return _row(top, case, F.col("label"), metric, F.col("value"), TOLERANCE)
    if tool in ("semantic_time_series", "trend_analysis"):
        metric = profile.column(metric_role or "", "revenue", "profit", "quantity")
        if not metric or not profile.column("date") or not is_numeric(df, metric):
            return None
        first = semantic_time_series(df, profile, metric_role).toDF("label", "value").orderBy("label").limit(1)
        return _row(first, case, F.col("label"), metric, F.col("value"), TOLERANCE)
    if tool == "semantic_target_summary":
        target, by = profile.column("target", "conversion"), profile.column(by_role or "")
        if not target:
            return None
        if by and by != target:
            top = semantic_target_summary(df, profile, by_role, 1).toDF("label", "rows", "rate")
            return _row(top, case, F.col("label"), "positive_rate", F.col("rate"), RATE_TOLERANCE)
        return _row(semantic_target_summary(df, profile), case, nothing, "positive_rate", F.col("positive_rate"), RATE_TOLERANCE)
    if tool == "detect_outliers":
        metric = profile.column(metric_role or "", "quantity", "revenue")
        if not metric or not is_numeric(df, metric):
            return None
        return _row(detect_outliers(df, metric), case, nothing, "outliers_count", F.col("outliers_count"), 0.0)
    if tool == "get_duplicate_rows":
        return _row(duplicate_count(df), case, nothing, "duplicate_rows", F.col("duplicate_rows"), 0.0)
    if tool == "get_dataset_overview":
        return _row(df.agg(F.count(F.lit(1)).alias("n")), case, nothing, "rows", F.col("n"), 0.0)
    if tool == "get_sales_overview":
        revenue = df.agg(F.sum(number(df, "revenue")).alias("x"))
        return _row(revenue, case, nothing, "total_revenue", F.col("x"), TOLERANCE)
    if tool == "top_skus_by_revenue":
        sums = df.groupBy("sku").agg(F.sum(number(df, "revenue")).alias("x"))
        top = sums.orderBy(F.desc_nulls_last("x"), F.asc_nulls_last("sku")).limit(1)
        return _row(top, case, F.col("sku"), "revenue", F.col("x"), TOLERANCE)
    return None


# A run is a table with one row per case: dataset, status, latency_ms and, per check,
# a nullable boolean that is null where the check does not apply.
RUN_CHECKS = ["domain", "metric_role", "dimension_role", "intent", "tool", "numeric", "answer_constraints"]


def _rate(*checks: str) -> Column:
    """Passed over applicable checks, 1.0 when none applies."""
    applicable = sum((F.count(F.col(c)) for c in checks[1:]), F.count(F.col(checks[0])))
    passed = sum((F.count_if(F.col(c)) for c in checks[1:]), F.count_if(F.col(checks[0])))
    return F.coalesce(F.try_divide(passed.cast("double"), applicable), F.lit(1.0))


def run_summary(run: DataFrame, missing_required: Sequence[str] = ()) -> DataFrame:
    """One row: case counts, rates, mean and nearest-rank 95th percentile latency, and verdicts."""
    late = exact_quantiles(run.select("latency_ms"), {"latency_ms": [0.95]}, nearest=True)["latency_ms"][0]
    status = lambda s: F.count_if(F.col("status") == s)
    active = F.count(F.lit(1)) - status("skipped")
    summary = run.agg(
        F.count(F.lit(1)).alias("total_cases"),
        status("passed").alias("passed_cases"),
        status("failed").alias("failed_cases"),
        status("error").alias("error_cases"),
        status("skipped").alias("skipped_cases"),
        _rate("domain").alias("domain_accuracy"),
        _rate("metric_role", "dimension_role").alias("role_mapping_accuracy"),
        _rate("intent").alias("intent_accuracy"),
        _rate("tool").alias("tool_accuracy"),
        _rate("numeric").alias("numeric_accuracy"),
        _rate("answer_constraints").alias("answer_constraint_pass_rate"),
        F.coalesce(F.try_divide(status("error").cast("double"), active), F.lit(0.0)).alias("error_rate"),
        rounded(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("average_latency_ms"),
        rounded(F.coalesce(F.lit(late).cast("double"), F.lit(0.0)), 1).alias("p95_latency_ms"),
    )
    passes = F.col("error_rate") <= THRESHOLDS["error_rate_max"]
    for name, floor in THRESHOLDS.items():
        if name != "error_rate_max":
            passes = passes & (F.col(name) >= floor)
    return summary.withColumn("overall_pass", passes & F.lit(not missing_required))


def run_summary_by_domain(run: DataFrame) -> DataFrame:
    """The same per domain, the part of the dataset name before the first slash."""
    status = lambda s: F.count_if(F.col("status") == s)
    domain = F.coalesce(F.nullif(F.substring_index(F.col("dataset"), "/", 1), F.lit("")), F.lit("generic"))
    return run.groupBy(domain.alias("domain")).agg(
        F.count(F.lit(1)).alias("total"),
        status("passed").alias("passed"),
        status("failed").alias("failed"),
        status("error").alias("errors"),
        status("skipped").alias("skipped"),
        _rate("intent").alias("intent_accuracy"),
        _rate("tool").alias("tool_accuracy"),
        _rate("numeric").alias("numeric_accuracy"),
        rounded(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("average_latency_ms"),
    )
