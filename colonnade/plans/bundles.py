"""Dashboards: the tables a domain's overview page is made of.

A bundle builds a table when it is asked for, so a table nobody looks at costs no job.
Nothing is cached here; a caller who will look at most tables of a bundle and has the
room can pass ``df.cache()``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col, is_numeric
from colonnade.operators import domain as tables
from colonnade.operators import grouped, insights, quality, semantic, stats
from colonnade.operators.cleaning import prepare_sales
from colonnade.operators.metrics import define_metric, evaluate_metric_summary, metric_breakdown, validate_metric
from colonnade.plans.roles import SemanticProfile, build_semantic_profile

Parts = dict[str, Callable[[], DataFrame]]


class Bundle(Mapping[str, DataFrame]):
    """Tables by id, each planned on first access."""

    def __init__(self, parts: Parts):
        self._parts = parts
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._parts[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def dashboard(
    df: DataFrame, profile: SemanticProfile | None = None, metrics: Sequence[Mapping[str, Any]] = (), findings: int | None = None
) -> Bundle:
    """Tables by id for the profile's domain, with custom metrics and general findings added.

    ``findings`` is how many of these are wanted; without it 8 where the domain has few tables, else 5.
    """
    profile = profile or build_semantic_profile(df)
    build = {
        "ecommerce": _ecommerce,
        "retail": _retail,
        "marketing": _marketing,
        "hr": _hr,
        "finance": _finance,
    }.get(profile.domain, _generic)
    parts = build(df, profile)
    parts.update(_custom_metrics(df, profile, metrics))
    wanted = findings or (8 if profile.domain in ("generic", "finance") else 5)
    parts["insights"] = lambda: insights.generate_insights(df, profile, metrics, wanted + 3).limit(wanted)
    return Bundle(parts)


def _cards(row: DataFrame, **cells: str) -> DataFrame:
    """Key figures as rows: label and value, from a one-row result."""
    entries = [F.struct(F.lit(label.replace("_", " ").title()).alias("label"), col(c).cast("double").alias("value")) for label, c in cells.items()]
    return row.select(F.explode(F.array(*entries)).alias("card")).select("card.*")


def _kpi_cards(kpis: DataFrame) -> DataFrame:
    return _cards(kpis, **{c: c for c in kpis.columns if c not in ("columns", "warnings")})


def _ecommerce(df: DataFrame, profile: SemanticProfile) -> Parts:
    sales = prepare_sales(df)
    figures = {"revenue": "total_revenue", "orders": "unique_orders", "cancel_rate": "cancel_rate", "quantity": "total_qty"}
    return {
        "kpis": lambda: _cards(grouped.get_sales_overview(sales), **figures),
        "ecom_category": lambda: grouped.revenue_by_category(sales),
        "ecom_state": lambda: grouped.top_states_by_revenue(sales, 10),
        "ecom_category_risk": lambda: grouped.category_cancellation_summary(sales),
        "ecom_month": lambda: grouped.revenue_by_month(sales),
    }


def _sections(df: DataFrame, profile: SemanticProfile, roles: Sequence[str]) -> Parts:
    """Monthly trend, and the leading metric by each role that exists."""
    metric = next((r for r in ("revenue", "profit") if r in profile.roles), "quantity")
    parts: Parts = {}
    if profile.column("date") and profile.column("revenue", "profit", "quantity"):
        parts["semantic_trend"] = lambda: semantic.semantic_time_series(df, profile)
    for role in roles:
        if role in profile.roles and metric in profile.roles and is_numeric(df, profile.column(metric)):
            parts[f"semantic_{role}"] = lambda role=role: semantic.semantic_breakdown(df, profile, role, metric)
    return parts


def _kpis(df: DataFrame, profile: SemanticProfile) -> Parts:
    return {"kpis": lambda: _kpi_cards(semantic.semantic_kpis(df, profile))}


def _retail(df: DataFrame, profile: SemanticProfile) -> Parts:
    return {
        **_kpis(df, profile),
        "retail_margin": lambda: tables.retail_margin_summary(df, profile),
        **_sections(df, profile, ["category", "state", "segment"]),
        "retail_losses": lambda: tables.retail_loss_analysis(df, profile, "category"),
        "retail_discount": lambda: tables.retail_discount_effect(df, profile),
        "retail_interaction": lambda: tables.retail_interaction(df, profile),
        "retail_opportunity": lambda: tables.retail_top_opportunities(df, profile),
    }


def _finance(df: DataFrame, profile: SemanticProfile) -> Parts:
    return {**_kpis(df, profile), **_sections(df, profile, ["category", "state"])}


def _marketing(df: DataFrame, profile: SemanticProfile) -> Parts:
    return {
        **_kpis(df, profile),
        "mkt_campaign_response": lambda: semantic.semantic_target_summary(df, profile, "campaign"),
        "mkt_country_response": lambda: tables.marketing_response_by_segment(df, profile, "country"),
        "mkt_campaign_acceptance": lambda: tables.marketing_campaign_acceptance(df, profile),
        "mkt_income_response": lambda: tables.marketing_income_band_response(df, profile),
        "mkt_channels": lambda: tables.marketing_purchase_channel_summary(df),
        "mkt_rfm": lambda: tables.marketing_rfm_summary(df, profile),
    }


def _hr(df: DataFrame, profile: SemanticProfile) -> Parts:
    by_role: Parts = {
        f"hr_{role}": lambda role=role: tables.hr_attrition_by_role(df, profile, role, 1)
        for role in ("department", "job_role", "overtime")
    }
    return {
        **_kpis(df, profile),
        **by_role,
        "hr_income": lambda: tables.hr_income_band_attrition(df, profile),
        "hr_tenure": lambda: tables.hr_tenure_risk(df, profile),
        "hr_high_risk": lambda: tables.hr_high_risk_segments(df, profile, 1),
    }


def _generic(df: DataFrame, profile: SemanticProfile) -> Parts:
    def kpis() -> DataFrame:
        gaps = quality.get_missing_values(df).agg(F.count_if("has_missing").alias("n")).scalar()
        overview = quality.get_dataset_overview(df).withColumn("missing_columns", gaps)
        return _cards(overview, **{c: c for c in ("rows", "columns", "duplicate_rows", "missing_columns")})

    return {
        "kpis": kpis,
        "generic_missing": lambda: quality.get_missing_values(df).drop("has_missing"),
        "generic_numeric": lambda: quality.generic_numeric_distributions(df),
        "generic_categorical": lambda: quality.generic_top_categorical_values(df),
        "generic_correlation": lambda: stats.correlation_analysis(df),
    }


def _custom_metrics(df: DataFrame, profile: SemanticProfile, metrics: Sequence[Mapping[str, Any]]) -> Parts:
    """Summaries of the metrics that compile, and the first one by the first dimension role."""
    usable, failed = [], []
    for metric in map(define_metric, metrics):
        try:
            validate_metric(metric, df, profile)
            usable.append(metric)
        except ValueError as error:
            failed.append((f"Custom metric `{metric.name or 'unknown'}` could not be evaluated: {error}",))
    parts: Parts = {}
    if failed:
        parts["warnings"] = lambda: df.sparkSession.createDataFrame(failed, "warning string")
    if not usable:
        return parts

    def summaries() -> DataFrame:
        result = evaluate_metric_summary(df, profile, usable[0])
        for other in usable[1:]:
            result = result.unionByName(evaluate_metric_summary(df, profile, other))
        return result

    parts["custom_metrics"] = summaries
    role = next((r for r in ("category", "segment", "state", "country", "department") if r in profile.roles), None)
    first = define_metric(metrics[0])
    if role and first in usable:
        parts[f"custom_metric_{first.name}_by_{role}"] = lambda: metric_breakdown(df, profile, first, by_role=role)
    return parts
