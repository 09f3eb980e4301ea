from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest

from colonnade.operators import domain, insights, metrics, semantic
from colonnade.plans.bundles import dashboard
from colonnade.plans.registry import operator_names, run
from colonnade.plans.roles import build_semantic_profile, profile_of
from tests.conftest import by, only, rows


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


# --- role detection -------------------------------------------------------------------


def test_retail_roles(spark):
    df = frame(spark, **{"Order Date": ["2024-01-01"], "Sales": [100.0], "Quantity": [2], "Segment": ["Consumer"], "State": ["California"]})
    profile = build_semantic_profile(df)
    assert {r: profile.roles[r].column for r in ("revenue", "quantity", "category", "date")} == {
        "revenue": "Sales", "quantity": "Quantity", "category": "Segment", "date": "Order Date",
    }
    assert profile.domain == "retail"
    json.dumps(profile.to_dict())


def test_marketing_and_hr(spark):
    marketing = build_semantic_profile(frame(spark, Customer_ID=[1], Campaign_Type=["Email"], Response=[1]))
    assert marketing.domain == "marketing"
    assert marketing.column("campaign") == "Campaign_Type" and marketing.column("target") == "Response"
    hr = build_semantic_profile(frame(spark, EmployeeNumber=[1], Attrition=["Yes"], Department=["Sales"], MonthlyIncome=[5993]))
    assert hr.domain == "hr" and hr.column("target") == "Attrition" and hr.column("salary") == "MonthlyIncome"


def test_logistics(spark):
    crashes = frame(
        spark,
        **{"CRASH DATE": ["2020-08-29"], "CRASH TIME": ["15:40:00"], "BOROUGH": ["BRONX"], "COLLISION_ID": [4342908], "Vehicle Type": ["Sedan"], "Accident Count": [1]},
    )
    profile = build_semantic_profile(crashes)
    assert profile.domain == "logistics"
    assert (profile.column("date"), profile.column("city")) == ("CRASH DATE", "BOROUGH")
    assert (profile.column("category"), profile.column("quantity")) == ("Vehicle Type", "Accident Count")
    rides = build_semantic_profile(frame(spark, **{"Date": ["2020-03-01"], "Transit Mode": ["Subways"], "Ridership": [2212965]}))
    assert rides.domain == "logistics" and rides.column("category") == "Transit Mode" and rides.column("quantity") == "Ridership"


def test_unknown_schema_is_generic(spark):
    profile = build_semantic_profile(frame(spark, A=[1], B=["x"]))
    assert profile.domain == "generic" and profile.warnings and profile.domain_confidence == 0.5


def test_overrides_win_over_dictionary(spark):
    df = frame(spark, **{"Sales": [100.0], "Profit": [20.0], "Segment": ["Consumer"], "Order Date": ["2024-01-01"]})
    dictionary = {"domain": "retail", "fields": [{"column_name": "Sales", "semantic_role": "revenue"}, {"column_name": "gone", "semantic_role": "cost"}]}
    stated = build_semantic_profile(df, {"data_dictionary": dictionary})
    assert stated.domain == "retail" and stated.roles["revenue"].source == "dictionary" and "cost" not in stated.roles
    chosen = build_semantic_profile(df, {"data_dictionary": dictionary, "domain": "finance", "roles": {"revenue": "Profit"}})
    assert chosen.domain == "finance" and chosen.domain_confidence == 1.0
    assert chosen.column("revenue") == "Profit" and chosen.roles["revenue"].confidence_label == "override"
    assert chosen.candidates["revenue"]
    assert chosen.domain_reasons[:2] == ["User domain override", "Data dictionary domain mapping"]


def test_scores(spark):
    profile = build_semantic_profile(frame(spark, sales=[1.0, 2.0], note=["a", "b"], created_at=["x", "y"]))
    best = profile.roles["revenue"]
    assert best.confidence == 0.9 and best.reason == "exact name match, compatible dtype" and best.confidence_label == "high"
    # an exact name that does not read as dates: 0.72 - 0.15
    assert profile.roles["date"].confidence == 0.57
    assert by(profile.candidates_frame(spark), "role")["revenue"]["column"] == "sales"


# --- role-driven operators ------------------------------------------------------------


def test_target_summary_where_group_is_target(spark):
    df = spark.createDataFrame([(1,), (0,), (1,), (0,), (1,)], "conversion int")
    profile = profile_of("marketing", target="conversion", conversion="conversion")
    assert only(semantic.semantic_target_rate(df, profile)) == {"target_column": "conversion", "positive_rate": 0.6}
    assert len(rows(semantic.semantic_target_summary(df, profile, "conversion"))) == 2


def test_target_denominator_includes_missing(spark):
    df = spark.createDataFrame([("a", "Yes"), ("a", None), ("a", " TRUE "), ("b", "no")], "g string, t string")
    profile = profile_of("hr", target="t", department="g")
    table = by(semantic.semantic_target_summary(df, profile, "department"), "g")
    assert table["a"] == {"g": "a", "rows": 2, "positive_rate": pytest.approx(2 / 3)}
    assert by(domain.target_group(df, "t", ["g"]), "g")["a"]["positives"] == 2


def test_kpis_series_breakdown(spark):
    df = spark.createDataFrame([("2024-01-01", 10.0, "a"), ("2024-02-01", 20.0, None), ("x", 5.0, "a")], "d string, s double, k string")
    profile = profile_of("retail", date="d", revenue="s", category="k")
    kpis = only(semantic.semantic_kpis(df, profile))
    assert kpis["rows"] == 3 and kpis["revenue"] == 35.0 and kpis["warnings"] == []
    assert rows(semantic.semantic_time_series(df, profile)) == [{"period": "2024-01", "s": 10.0}, {"period": "2024-02", "s": 20.0}]
    assert rows(semantic.semantic_breakdown(df, profile, "category")) == [{"k": None, "s": 20.0}, {"k": "a", "s": 15.0}]
    assert rows(semantic.semantic_breakdown(df, profile, "city")) == []
    lacking = only(semantic.semantic_kpis(df, profile_of("retail", category="k")))
    assert lacking["warnings"] == ["Revenue role is missing or non-numeric."]
    assert only(semantic.semantic_overview(df, profile))["roles"][0] == {"role": "date", "column": "d"}


# --- retail, marketing, workforce -----------------------------------------------------


def test_discount_bands_keep_empty_ones(spark):
    df = spark.createDataFrame([(0.0, 10.0, 1.0), (None, 5.0, 1.0), (0.1, 20.0, -2.0), (0.3, 8.0, 4.0)], "discount double, sales double, profit double")
    profile = profile_of("retail", discount="discount", revenue="sales", profit="profit")
    table = rows(domain.retail_discount_effect(df, profile))
    assert [(r["discount_band"], r["rows"], r["revenue"]) for r in table] == [("0", 1, 15.0), ("0-10%", 1, 20.0), ("10-20%", 0, 0.0), ("20-40%", 1, 8.0), ("40%+", 0, 0.0)]
    assert table[2]["avg_discount"] is None and table[2]["margin"] is None and table[1]["margin"] == -0.1


def test_retail_groups(spark, size):
    df = spark.createDataFrame([("a", 10.0, -5.0), ("b", 100.0, 1.0), ("c", 50.0, -1.0), ("d", 0.0, -3.0), (None, 70.0, 30.0)], "k string, sales double, profit double")
    profile = profile_of("retail", revenue="sales", profit="profit", category="k")
    losses = rows(domain.retail_loss_analysis(df, profile))
    assert [r["k"] for r in losses] == ["a", "d", "c"] and losses[1]["margin"] is None
    chances = rows(domain.retail_top_opportunities(df, profile))
    # 60th percentile of 0, 10, 50, 70, 100 is 58
    assert [(r["k"], r["rows"]) for r in chances] == [("b", 1), (None, 0)]
    margin = only(domain.retail_margin_summary(df, profile))
    assert margin["margin"] == pytest.approx(22 / 230) and margin["loss_rows"] == 3
    assert rows(domain.retail_interaction(df, profile)) == []
    assert "warning" in domain.retail_margin_summary(df, profile_of("retail")).columns


def test_marketing(spark, size):
    pdf = pd.DataFrame(
        {
            "Income": [10.0, 20.0, 30.0, 40.0, 50.0, None], "Response": [1, 0, 1, 1, 0, 1], "MntWines": [5, 1, 9, 3, 7, 2], "MntMeat": [0, 0, 0, 0, 0, 100],
            "NumWebPurchases": [1, 2, 3, 4, 5, 6], "NumStorePurchases": [1, 1, 1, 1, 1, 1], "AcceptedCmp1": [0, 0, 1, 0, 1, 1], "Recency": [3, 1, 2, 9, 9, 9],
        }
    )
    df = spark.createDataFrame(pdf)
    profile = profile_of("marketing", salary="Income", target="Response", recency="Recency")
    bands = rows(domain.marketing_income_band_response(df, profile))
    assert [(r["band_index"], r["rows"], r["avg_income"]) for r in bands] == [(1, 1, 10.0), (2, 1, 20.0), (3, 1, 30.0), (4, 1, 40.0), (5, 1, 50.0), (None, 1, None)]
    assert [r["positive_rate"] for r in bands] == [1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    rfm = rows(domain.marketing_rfm_summary(df, profile))
    total = pdf[["MntWines", "MntMeat"]].sum(axis=1)
    cut = pd.qcut(total.rank(method="first"), 4)
    assert [r["customers"] for r in rfm] == cut.value_counts(sort=False).tolist()
    assert [r["avg_monetary"] for r in rfm] == pytest.approx(total.groupby(cut, observed=False).mean().tolist())
    summary = by(domain.marketing_rfm_statistics(df, profile), "measure")
    assert summary["monetary"]["median"] == total.median() and summary["recency"]["mean"] == pdf.Recency.mean()
    assert only(domain.marketing_campaign_acceptance(df, profile)) == {"campaign": "AcceptedCmp1", "acceptance_rate": 0.5, "accepted": 3, "rows": 6}
    assert [(r["channel"], r["total_purchases"]) for r in rows(domain.marketing_purchase_channel_summary(df))] == [("web", 21.0), ("store", 6.0)]


def test_workforce(spark):
    df = spark.createDataFrame(
        [("x", "Yes", 0.5, "y"), ("x", "No", 2.0, "n"), ("z", "No", 12.0, "n"), ("z", None, None, "n")], "dept string, left string, years double, over string"
    )
    profile = profile_of("hr", department="dept", target="left", tenure="years", overtime="over")
    risk = rows(domain.hr_tenure_risk(df, profile))
    assert [(r["tenure_band"], r["rows"]) for r in risk] == [("<=1", 1), ("1-3", 1), ("3-5", 0), ("5-10", 0), ("10+", 1), (None, 0)]
    assert [r["dept"] for r in rows(domain.hr_attrition_by_role(df, profile, "department", min_rows=2))] == ["x"]
    cells = rows(domain.hr_high_risk_segments(df, profile, min_rows=1))
    assert [(r["dept"], r["over"], r["attrition_rate"]) for r in cells] == [("x", "y", 1.0), ("x", "n", 0.0), ("z", "n", 0.0)]
    assert "warning" in domain.hr_income_band_attrition(df, profile).columns


# --- user metrics ---------------------------------------------------------------------

MARGIN = {"name": "margin", "expression": "profit / revenue", "format": "percent", "aggregation": "mean", "required_roles": ["profit", "revenue"]}


def test_metric_over_roles(spark, size):
    df = frame(spark, Sales=[100.0, 200.0], Profit=[10.0, 50.0], Category=["A", "B"])
    profile = build_semantic_profile(df)
    summary = only(metrics.evaluate_metric_summary(df, profile, MARGIN))
    assert summary["value"] == pytest.approx(0.175) and summary["label"] == "Margin" and summary["result_type"] == "series"
    assert only(metrics.evaluate_metric_summary(df, profile, {**MARGIN, "aggregation": "median"}))["value"] == pytest.approx(0.175)
    assert len(rows(metrics.metric_samples(df, profile, MARGIN))) == 2


def test_metric_division_by_zero_is_missing(spark):
    df = frame(spark, revenue=[100.0, 0.0, math.inf], profit=[10.0, 5.0, 1.0])
    profile = build_semantic_profile(df)
    values = [r["margin"] for r in rows(metrics.evaluate_metric(df, profile, {"name": "margin", "expression": "profit / revenue"}))]
    assert values == [0.1, None, 0.0]
    huge = [r["m"] for r in rows(metrics.evaluate_metric(df, profile, {"name": "m", "expression": "revenue * 2"}))]
    assert huge == [200.0, 0.0, None]


def test_metric_column_names_and_scalars(spark):
    df = frame(spark, **{"Sales": [100.0, 200.0], "Web Visits": [10.0, 20.0], "2nd": [1.0, np.nan]})
    profile = build_semantic_profile(df)
    value = lambda text, how="mean": only(metrics.evaluate_metric_summary(df, profile, {"name": "m", "expression": text, "aggregation": how}))
    assert value("Sales / Web_Visits")["value"] == 10.0
    assert value("-Sales + 2 * +Web_Visits", "sum")["value"] == -240.0
    scalar = value("sum(Sales) / count(col_2nd) - mean(Sales - mean(Sales))")
    assert (scalar["value"], scalar["result_type"], scalar["valid_count"]) == (300.0, "scalar", 1)
    assert value("safe_div(sum(Sales), 0)")["missing_count"] == 1
    assert value("Sales / sum(Sales)", "max")["value"] == pytest.approx(2 / 3)
    assert value("count(5)")["value"] == 1.0


def test_metric_rejections(spark):
    df = frame(spark, Sales=[100.0], Kind=["x"])
    profile = build_semantic_profile(df)
    bad = ["__import__('os').system('x')", "Sales ** 2", "abs(Sales)", "Kind + 1", "sum(Sales, 2)", "'a'", "", "Sales +", "sum(x=Sales)", "not Sales", "__class__"]
    for text in bad:
        with pytest.raises(ValueError):
            metrics.validate_metric({"name": "m", "expression": text}, df, profile)
    for change in ({"name": "1m"}, {"format": "roman"}, {"aggregation": "mode"}, {"required_roles": "profit, cost"}):
        with pytest.raises(ValueError):
            metrics.validate_metric({"name": "m", "expression": "Sales", **change}, df, profile)
    assert metrics.validate_metric({"name": "m", "expression": "1 + 2"}, df, profile)


def test_metric_breakdown(spark):
    df = frame(spark, Sales=[100.0, 200.0, 300.0], Profit=[10.0, 40.0, 30.0], Category=["A", "A", "B"])
    profile = build_semantic_profile(df)
    table = rows(metrics.metric_breakdown(df, profile, MARGIN, by_role="category"))
    assert table[0]["Category"] == "A" and table[0]["margin"] == pytest.approx(0.15)
    worst = rows(metrics.metric_breakdown(df, profile, {**MARGIN, "higher_is_better": False}, by_column="Category"))
    assert worst[0]["Category"] == "B"
    for arguments in ({}, {"by_column": "gone"}, {"by_role": "category", "limit": 0}):
        with pytest.raises(ValueError):
            metrics.metric_breakdown(df, profile, MARGIN, **arguments)
    assert metrics.find_metric([MARGIN], "MARGIN").expression == "profit / revenue"
    with pytest.raises(ValueError):
        metrics.find_metric([MARGIN], "other")


# --- findings and dashboards ----------------------------------------------------------


def test_findings(spark, size):
    df = frame(spark, **{"Order Date": ["2024-01-01", "2024-02-01", "2024-03-01"], "Sales": [100.0, 150.0, 300.0], "Category": ["A", "B", "A"]})
    profile = build_semantic_profile(df)
    top = only(insights.top_contributor_finding(df, profile))
    assert (top["label"], top["value"], top["share"]) == ("A", 400.0, pytest.approx(400 / 550))
    trend = only(insights.trend_finding(df, profile))
    assert (trend["value"], trend["other_value"], trend["share"], trend["tone"]) == (300.0, 100.0, 2.0, "positive")
    gap = only(insights.segment_gap_finding(df, profile))
    assert (gap["label"], gap["other_label"], gap["value"]) == ("A", "B", 200.0)
    assert rows(insights.concentration_finding(df, profile)) == []
    out = only(insights.outlier_finding(spark.createDataFrame([(v,) for v in (1, 2, 2, 2, 3, 100)], "value int")))
    assert out["metric"] == "value" and out["row_count"] == 1
    pair = only(insights.correlation_finding(frame(spark, a=[1, 2, 3, 4], b=[2, 4, 6, 8], c=[8, 7, 6, 6])))
    assert (pair["metric"], pair["dimension"], pair["value"]) == ("a", "b", pytest.approx(1.0))


def test_quality_findings(spark):
    df = spark.createDataFrame([(1, "x", "k"), (None, "y", "k"), (None, "y", "k"), (None, "y", "k")], "a int, b string, c string")
    found = {r["label"]: r for r in rows(insights.data_quality_findings(df))}
    assert found["missing"]["dimension"] == "a" and found["missing"]["value"] == 0.75 and found["missing"]["severity"] == "warning"
    assert found["duplicates"]["value"] == 2.0 and found["duplicates"]["share"] == 0.5
    assert found["constant"]["dimension"] == "a, c" and found["constant"]["value"] == 2.0


def test_concentration(spark, size):
    df = spark.createDataFrame([("a", 50.0), ("b", 29.0), ("c", 11.0), ("d", 10.0)], "k string, s double")
    found = only(insights.concentration_finding(df, profile_of("retail", revenue="s", category="k")))
    assert (found["value"], found["row_count"], found["share"]) == (2.0, 4, 0.5)


def test_findings_on_tiny_tables(spark):
    for df in (frame(spark, name=["a", "b"], kind=["x", "y"]), frame(spark, only=["x"])):
        rows(insights.generate_insights(df, build_semantic_profile(df)))


def test_custom_metric_leads_findings(spark):
    df = frame(spark, Sales=[100.0, 10.0], Profit=[10.0, 9.0], Category=["A", "B"])
    found = only(insights.top_contributor_finding(df, build_semantic_profile(df), [{"name": "bad", "expression": "nope"}, MARGIN]))
    assert found["metric"] == "margin" and found["label"] == "B"


def test_dashboards(spark):
    retail = frame(spark, **{"Order Date": ["2024-01-01", "2024-02-01"], "Sales": [100.0, 200.0], "Profit": [10.0, 20.0], "Quantity": [1, 2], "Segment": ["Consumer", "Corporate"], "State": ["A", "B"]})
    bundle = dashboard(retail, metrics=[MARGIN, {"name": "x", "expression": "nope"}])
    assert {"kpis", "semantic_trend", "semantic_state", "retail_losses", "custom_metrics", "custom_metric_margin_by_category", "warnings", "insights"} <= set(bundle)
    assert {r["label"]: r["value"] for r in rows(bundle["kpis"])} == {"Rows": 2.0, "Revenue": 300.0, "Profit": 30.0, "Quantity": 3.0}
    marketing = dashboard(frame(spark, ID=[1, 2, 3], Campaign_Type=["Email", "Email", "Ads"], Response=[1, 0, 1], Country=["A", "A", "B"], Income=[100.0, 200.0, 300.0]))
    assert by(marketing["mkt_campaign_response"], "Campaign_Type")["Ads"]["positive_rate"] == 1.0
    hr = dashboard(frame(spark, EmployeeNumber=[1, 2, 3], Attrition=["Yes", "No", "No"], Department=["Sales", "Sales", "R&D"], MonthlyIncome=[1000, 2000, 3000]))
    assert by(hr["hr_department"], "Department")["Sales"]["positive_rate"] == 0.5
    generic = dashboard(spark.createDataFrame([(1, "x"), (2, None)], "A int, B string"))
    assert {r["label"]: r["value"] for r in rows(generic["kpis"])}["Missing Columns"] == 1.0
    for bundle in (marketing, hr, generic):
        for name in bundle:
            rows(bundle[name])


def test_ecommerce_dashboard_and_registry(spark):
    raw = spark.createDataFrame(
        [("1", "04-30-22", "Cancelled", "kurta", 1, 100.0, "a", "b", "M"), ("2", "05-01-22", "Shipped", "set", 2, 50.0, "c", "d", "M")],
        "`Order ID` string, Date string, Status string, Category string, Qty int, Amount double, SKU string, `ship-state` string, Fulfilment string",
    )
    bundle = dashboard(raw)
    assert by(bundle["ecom_category"], "category")["Kurta"]["revenue"] == 100.0
    assert by(run("revenue_by_month", raw), "order_month")["2022-05"]["revenue"] == 50.0
    assert only(run("groupby_aggregate", raw, group_by="Status", metric="Qty", aggregation="sum", limit=1))["sum_Qty"] == 2
    assert rows(run("generate_chart_spec", raw, chart_type="bar", x="Status"))
    metric = {"name": "unit", "expression": "Amount / Qty"}
    assert only(run("evaluate_custom_metric", raw, custom_metrics=[metric], metric_name="Unit"))["value"] == 62.5
    assert rows(run("custom_metric_breakdown", raw, custom_metrics=[metric], metric_name="unit", by_column="Status"))[0]["unit"] == 100.0
    assert only(run("semantic_kpis", raw))["rows"] == 2
    with pytest.raises(ValueError, match="not available"):
        run("revenue_by_month", raw.drop("Status"))
    with pytest.raises(ValueError, match="Unsupported"):
        run("teleport", raw)
    with pytest.raises(TypeError):
        run("get_missing_values", raw, nonsense=1)
    assert len(operator_names()) >= 51


def test_column_facts_read_the_table_once(spark):
    from colonnade.plans.roles import column_facts

    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "day string, kind string, note string, n double, at date, yes boolean, gone string"
    data = [(f"2024-01-{1 + i % 28:02d}", "ab"[i % 2], f"note {i}" * 9, float("nan") if i % 2 else 1.0, None, True, None) for i in range(120)]
    df = spark.createDataFrame(data, schema).mapInPandas(tell, schema)
    found = {r["column"]: [k for k in ("numeric", "repeated_text", "date_like", "yes_no", "short_text") if r[k]] for r in column_facts(df).collect()}
    assert seen.value == 120
    assert found == {
        "day": ["repeated_text", "date_like", "short_text"], "kind": ["repeated_text"], "note": [], "n": ["numeric", "short_text"],
        "at": [], "yes": ["numeric", "yes_no", "short_text"], "gone": [],
    }
    assert all(not (r["repeated_text"] or r["date_like"] or r["yes_no"]) for r in column_facts(spark.createDataFrame([], schema)).collect())
