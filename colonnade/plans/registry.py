"""Operators by name: ``run("pareto_analysis", df, category_column="c", metric_column="m")``."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from colonnade.operators import charts, compare, domain, grouped, metrics, quality, ranking, semantic, series, stats, user_functions
from colonnade.operators.cleaning import prepare_sales
from colonnade.plans.roles import SemanticProfile, build_semantic_profile

#: Operators over the table itself.
PLAIN: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        quality.get_dataset_overview,
        quality.get_missing_values,
        quality.get_duplicate_rows,
        quality.generic_numeric_distributions,
        quality.generic_top_categorical_values,
        grouped.groupby_aggregate,
        stats.correlation_analysis,
        stats.detect_outliers,
        stats.outlier_rows,
        compare.compare_segments,
        compare.period_over_period_change,
        compare.explain_metric_change,
        compare.explain_metric_change_totals,
        series.trend_analysis,
        series.anomaly_detection,
        series.anomaly_periods,
        series.forecast_next_period,
        series.cohort_summary,
        ranking.top_bottom_contributors,
        ranking.pareto_analysis,
        charts.chart_data,
        domain.marketing_purchase_channel_summary,
        user_functions.user_function,
    )
}
#: Operators that take a semantic profile as second argument.
SEMANTIC: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        semantic.semantic_overview,
        semantic.semantic_kpis,
        semantic.semantic_time_series,
        semantic.semantic_breakdown,
        semantic.semantic_target_rate,
        semantic.semantic_target_summary,
        domain.retail_margin_summary,
        domain.retail_loss_analysis,
        domain.retail_discount_effect,
        domain.retail_interaction,
        domain.retail_top_opportunities,
        domain.marketing_response_by_segment,
        domain.marketing_campaign_acceptance,
        domain.marketing_rfm_summary,
        domain.marketing_rfm_statistics,
        domain.marketing_income_band_response,
        domain.hr_attrition_by_role,
        domain.hr_income_band_attrition,
        domain.hr_tenure_risk,
        domain.hr_high_risk_segments,
    )
}
#: Operators over prepared order lines.
SALES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        grouped.get_sales_overview,
        quality.get_data_quality_summary,
        grouped.revenue_by_month,
        grouped.revenue_by_category,
        grouped.top_states_by_revenue,
        grouped.top_skus_by_revenue,
        grouped.revenue_by_size,
        grouped.category_cancellation_summary,
        grouped.fulfilment_summary,
        grouped.courier_summary,
        grouped.promotion_summary,
        grouped.b2b_summary,
        grouped.top_cities_by_revenue,
        grouped.state_cancellation_summary,
        grouped.cancellation_summary,
        grouped.cancellation_by_dimension,
    )
}
ALIASES = {"generate_chart_spec": "chart_data"}
# Columns whose presence marks a raw order-line table.
ORDER_LINE_COLUMNS = ["order_id", "date", "status", "category", "qty", "amount"]


def operator_names() -> list[str]:
    return sorted([*PLAIN, *SEMANTIC, *SALES, *ALIASES, "evaluate_custom_metric", "custom_metric_breakdown"])


def _call(function: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> DataFrame:
    inspect.signature(function).bind(*args, **kwargs)
    return function(*args, **kwargs)


def run(
    name: str,
    df: DataFrame,
    profile: SemanticProfile | None = None,
    custom_metrics: Sequence[Mapping[str, Any]] = (),
    **arguments: Any,
) -> DataFrame:
    """Run one operator.  A profile is detected when an operator needs one and none is given."""
    name = ALIASES.get(name, name)
    if name in PLAIN:
        return _call(PLAIN[name], df, **arguments)
    if name in SALES:
        prepared = prepare_sales(df)
        if not set(ORDER_LINE_COLUMNS) <= set(prepared.columns):
            raise ValueError("Ecommerce tools are not available for this dataset.")
        return _call(SALES[name], prepared, **arguments)
    if name in SEMANTIC:
        return _call(SEMANTIC[name], df, profile or build_semantic_profile(df), **arguments)
    if name in ("evaluate_custom_metric", "custom_metric_breakdown"):
        metric = metrics.find_metric(custom_metrics, arguments.pop("metric_name", ""))
        function = metrics.evaluate_metric_summary if name == "evaluate_custom_metric" else metrics.metric_breakdown
        return _call(function, df, profile or build_semantic_profile(df), metric, **arguments)
    raise ValueError(f"Unsupported tool: {name}")
