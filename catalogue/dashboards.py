"""A table of every dashboard, with the SQL of the operator that fills it."""

from __future__ import annotations

import dataclasses

from catalogue import ORACLES, query
from catalogue.generic import METRIC_PROFILE, UNIT_PRICE
from catalogue.views import PEOPLE_PROFILE, RETAIL_PROFILE, outcomes, people, retail, table
from colonnade.plans.bundles import dashboard
from colonnade.plans.roles import profile_of


@query("dashboard_marketing_spend", ORACLES["marketing_rfm_summary"])
def _(spark, sf):
    return dashboard(people(spark, sf), dataclasses.replace(PEOPLE_PROFILE, domain="marketing"))["mkt_rfm"]


@query("dashboard_marketing_channels", ORACLES["marketing_purchase_channels"])
def _(spark, sf):
    return dashboard(people(spark, sf), dataclasses.replace(PEOPLE_PROFILE, domain="marketing"))["mkt_channels"]


@query("dashboard_hr_tenure", ORACLES["hr_tenure_risk"])
def _(spark, sf):
    return dashboard(people(spark, sf), PEOPLE_PROFILE)["hr_tenure"]


@query(
    "dashboard_finance_trend",
    "SELECT strftime(l_shipdate, '%Y-%m') AS period, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    profile = profile_of("finance", revenue="l_extendedprice", date="l_shipdate")
    return dashboard(table(spark, sf, "lineitem"), profile)["semantic_trend"]


@query(
    "dashboard_generic_missing",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percent "
        "FROM (SELECT d.doc_id, lang, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
        for c in ("doc_id", "lang", "toxic")
    ),
)
def _(spark, sf):
    return dashboard(outcomes(spark, sf).select("doc_id", "lang", "toxic"), profile_of())["generic_missing"]


@query(
    "dashboard_retail_segments",
    """SELECT c_mktsegment AS segment, sum(l_extendedprice * (1 - l_discount)) AS sales FROM lineitem
    LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def _(spark, sf):
    return dashboard(retail(spark, sf, "customer"), RETAIL_PROFILE)["semantic_segment"]


@query("dashboard_custom_metrics", ORACLES["metric_summary_mean"])
def _(spark, sf):
    parts = dashboard(table(spark, sf, "lineitem"), METRIC_PROFILE, [{**UNIT_PRICE, "aggregation": "mean"}])
    return parts["custom_metrics"].select("name", "aggregation", "value", "valid_count", "missing_count", "result_type")
