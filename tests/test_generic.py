from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from colonnade.operators import charts, compare, quality, ranking, series, stats
from colonnade.plans.quantiles import exact_quantiles, grouped_median
from tests.conftest import by, only, rows


def dated(spark, values, *extra):
    names = ["Date string, Val long", *extra]
    return spark.createDataFrame(values, ", ".join(names))


# --- comparison -----------------------------------------------------------------------


def test_compare_segments(spark):
    df = spark.createDataFrame([("A", 10), ("A", 20), ("B", 30), ("B", 40), (None, 9)], "Group string, Val long")
    result = only(compare.compare_segments(df, "Group", "A", "B", "Val", "mean"))
    assert result["value_a"] == 15.0 and result["value_b"] == 35.0 and result["percentage_difference"] == -57.14
    assert result["conclusion"] == "Segment 'A' is 57.14% lower than 'B'"
    absent = only(compare.compare_segments(df, "Group", "A", "Z", "Val", "median"))
    assert absent["value_a"] == 15.0 and absent["value_b"] == 0.0 and absent["percentage_difference"] == 0.0
    with pytest.raises(ValueError):
        compare.compare_segments(df, "Group", "A", "B", "Group", "mean")


def test_period_over_period(spark):
    df = dated(spark, [("2026-01-01", 10), ("2026-01-15", 20), ("2026-02-01", 30), ("2026-02-15", 40), ("bad", 99)])
    result = only(compare.period_over_period_change(df, "Date", "Val", "2026-02-01", "2026-02-28", "2026-01-01", "2026-01-31"))
    assert result["value_a"] == 70.0 and result["value_b"] == 30.0 and result["percentage_difference"] == 133.33


def test_period_end_is_midnight(spark):
    df = dated(spark, [("2024-01-31 00:00:00", 1), ("2024-01-31 00:00:01", 5)])
    result = only(compare.period_over_period_change(df, "Date", "Val", "2024-01-01", "2024-01-31", "2023-01-01", "2023-01-31"))
    assert result["value_a"] == 1.0 and result["value_b"] == 0.0 and result["percentage_difference"] == 0.0


def test_explain_metric_change(spark):
    df = dated(spark, [("2026-01-01", 100, "X"), ("2026-02-01", 150, "X"), ("2026-02-02", 25, None), ("2026-01-02", 50, "Y")], "Dim string")
    bounds = ("2026-02-01", "2026-02-28", "2026-01-01", "2026-01-31")
    parts = rows(compare.explain_metric_change(df, "Date", "Val", "Dim", *bounds))
    assert [(r["dimension_value"], r["absolute_change"]) for r in parts] == [("X", 50.0), ("Y", -50.0), (None, 25.0)]
    assert [r["contribution_to_change_percent"] for r in parts] == [200.0, -200.0, 100.0]
    totals = only(compare.explain_metric_change_totals(df, "Date", "Val", "Dim", *bounds))
    assert totals == {"period_a_total": 175.0, "period_b_total": 150.0, "absolute_change": 25.0, "percentage_change": 16.67}


# --- series ---------------------------------------------------------------------------


def test_trend(spark):
    df = dated(spark, [("2026-01-01", 100), ("2026-02-01", 110), ("2026-03-01", 121), ("nope", 7)])
    trend = rows(series.trend_analysis(df, "Date", "Val", "M", "sum"))
    assert [r["period"] for r in trend] == ["2026-01", "2026-02", "2026-03"]
    assert trend[0]["pct_change"] is None and {r["average_growth_rate"] for r in trend} == {10.0}
    assert [r["period"] for r in rows(series.trend_analysis(df, "Date", "Val", "Q", "mean"))] == ["2026Q1"]
    assert [r["period"] for r in rows(series.trend_analysis(df, "Date", "Val", "Y", "count"))] == ["2026"]
    week = rows(series.trend_analysis(df, "Date", "Val", "W", "max"))[0]["period"]
    assert week == str(pd.Timestamp("2026-01-01").to_period("W"))
    with pytest.raises(ValueError):
        series.trend_analysis(df, "Date", "Val", "fortnight")


def test_trend_from_zero_base(spark):
    df = dated(spark, [("2026-01-01", 0), ("2026-02-01", 10)])
    assert [r["pct_change"] for r in rows(series.trend_analysis(df, "Date", "Val"))] == [None, None]


def test_anomaly(spark):
    df = dated(spark, [(f"2026-0{i + 1}-01", v) for i, v in enumerate([10, 11, 12, 100, 10])])
    found = rows(series.anomaly_detection(df, "Date", "Val", "M", 1.0))
    assert [r["period"] for r in found] == ["2026-04"]
    everything = rows(series.anomaly_periods(df, "Date", "Val", "M"))
    values = pd.Series([10, 11, 12, 100, 10])
    assert [r["z_score"] for r in everything] == pytest.approx(list((values - values.mean()) / values.std()))
    assert rows(series.anomaly_periods(df.limit(2), "Date", "Val")) == []
    flat = dated(spark, [(f"2026-0{i + 1}-01", 5) for i in range(4)])
    assert {(r["std"], r["z_score"]) for r in rows(series.anomaly_periods(flat, "Date", "Val"))} == {(1.0, 0.0)}


def test_forecast(spark):
    df = dated(spark, [("2026-01-01", 100), ("2026-02-01", 110), ("2026-03-01", 120)])
    assert rows(series.forecast_next_period(df, "Date", "Val", 2)) == [
        {"period": "2026-04", "forecast_value": 118.1},
        {"period": "2026-05", "forecast_value": 128.1},
    ]
    falling = dated(spark, [("2026-10-01", 100), ("2026-11-01", 50), ("2026-12-01", 0)])
    later = rows(series.forecast_next_period(falling, "Date", "Val", 3))
    assert later[0]["period"] == "2027-01" and later[-1]["forecast_value"] == 0.0
    assert rows(series.forecast_next_period(df.limit(2), "Date", "Val")) == []


def test_cohorts(spark):
    df = spark.createDataFrame(
        [("2026-01-01", "2026-01-15", "U1"), ("2026-01-01", "2026-02-15", "U1"), ("2026-02-01", "2026-02-15", "U2"),
         ("2026-01-09", "2026-01-20", "U3"), ("2026-03-01", "2026-02-01", "U4"), ("2026-05-01", "2026-06-01", "U5"), (None, "2026-06-01", "U6")],
        "c string, a string, u string",
    )
    table = {(r["cohort_period"], r["activity_period"]): r for r in rows(series.cohort_summary(df, "c", "a", "u"))}
    assert set(table) == {("2026-01", "2026-01"), ("2026-01", "2026-02"), ("2026-02", "2026-02"), ("2026-05", "2026-06")}
    later = table["2026-01", "2026-02"]
    assert (later["users"], later["cohort_size"], later["cohort_lifetime"], later["retention_rate"]) == (1, 2, 1, 50.0)
    assert table["2026-05", "2026-06"]["cohort_size"] is None and table["2026-05", "2026-06"]["retention_rate"] is None


# --- ranking --------------------------------------------------------------------------


def test_contributors(spark):
    df = spark.createDataFrame([("Apple", 100), ("Banana", 50), ("Cherry", 10)], "Category string, Sales long")
    result = rows(ranking.top_bottom_contributors(df, "Category", "Sales", 2))
    order = [(r["side"], r["position"], r["Category"]) for r in sorted(result, key=lambda r: (r["side"], r["position"]))]
    assert order == [("bottom", 1, "Cherry"), ("bottom", 2, "Banana"), ("top", 1, "Apple"), ("top", 2, "Banana")]
    assert {r["total_sum"] for r in result} == {160.0}
    nothing = df.selectExpr("Category", "Sales - Sales AS Sales")
    assert {r["contribution_percent"] for r in rows(ranking.top_bottom_contributors(nothing, "Category", "Sales"))} == {0.0}


def test_pareto(spark, size):
    df = spark.createDataFrame([("A", 80), ("B", 10), ("C", 5), ("D", 3), ("E", 2)], "Category string, Sales long")
    only_one = only(ranking.pareto_analysis(df, "Category", "Sales"))
    assert only_one["Category"] == "A" and only_one["contributors_count"] == 1 and only_one["categories_percent"] == 20.0
    steep = spark.createDataFrame([("A", 90), (None, 10)], "Category string, Sales long")
    assert only(ranking.pareto_analysis(steep, "Category", "Sales"))["Category"] == "A"
    zero = spark.createDataFrame([("A", 1), ("B", -1)], "Category string, Sales long")
    assert rows(ranking.pareto_analysis(zero, "Category", "Sales")) == []


def test_pareto_of_many_groups_matches_pandas(spark, size):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 400, 3000), "x": rng.integers(1, 1000, 3000).astype(float)})
    result = rows(ranking.pareto_analysis(spark.createDataFrame(pdf), "k", "x"))
    totals = pdf.groupby("k").x.sum().reset_index().sort_values(["x", "k"], ascending=[False, True])
    share = (totals.x.cumsum() / totals.x.sum() * 100).round(2)
    kept = totals[share <= 80]
    assert sorted(r["k"] for r in result) == sorted(kept.k)
    assert {r["contributors_count"] for r in result} == {len(kept)}


@pytest.mark.parametrize("n,bands", [(1, 4), (2, 4), (6, 4), (7, 2), (59, 4), (60, 5), (101, 5)])
def test_rank_bands_match_quantile_cut(spark, size, n, bands):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"m": rng.permutation(n).astype(float), "e": rng.integers(0, 2, n)})
    cells = ranking.rank_bands(spark.createDataFrame(pdf), "m", ["e"], bands).toPandas()
    got = cells.groupby("band_index").n.sum().tolist()
    cut = pd.qcut(pdf.m.rank(method="first"), q=min(bands, n), duplicates="drop")
    assert got == cut.value_counts(sort=False).tolist()


def test_rank_bands_split_ties(spark, size):
    pdf = pd.DataFrame({"m": [5.0] * 30 + [7.0] * 6, "e": [0, 1, 1] * 12})
    cells = ranking.rank_bands(spark.createDataFrame(pdf), "m", ["e"], 4).toPandas()
    # two distinct values give two bands; the first ends at rank 1 + 35 / 2
    assert cells.groupby("band_index").n.sum().tolist() == [18, 18]
    assert cells[cells.band_index == 1].m.unique().tolist() == [5.0]
    assert cells.n.sum() == 36


def test_rank_bands_keep_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 1), (2.0, 0)], "m double, e int")
    cells = rows(ranking.rank_bands(df, "m", ["e"], 5))
    assert sorted((r["band_index"] or 0, r["n"]) for r in cells) == [(0, 1), (1, 1), (2, 1)]


# --- statistics -----------------------------------------------------------------------


def test_outliers(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 100)], "Val long")
    found = only(stats.detect_outliers(df, "Val", "iqr"))
    assert found["outliers_count"] == 1 and found["outliers_percent"] == 20.0 and (found["lower"], found["upper"]) == (-1.0, 7.0)
    assert rows(stats.outlier_rows(df, "Val")) == [{"Val": 100}]
    spread = pd.Series([1, 2, 3, 4, 100])
    wide = only(stats.detect_outliers(df, "Val", "zscore"))
    assert wide["upper"] == pytest.approx(spread.mean() + 3 * spread.std()) and wide["outliers_count"] == 0
    none = only(stats.detect_outliers(df.selectExpr("cast(null as double) AS Val"), "Val"))
    assert none["outliers_count"] == 0 and none["lower"] is None


def test_quantiles_match_pandas(spark, size):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(
        {
            "smooth": rng.normal(size=800),
            "hot": np.where(rng.random(800) < 0.6, 0.0, rng.integers(1, 200, 800)).astype(float),
            "heavy": np.exp(rng.normal(size=800) * 8),
            "gaps": np.where(rng.random(800) < 0.7, np.nan, rng.normal(size=800)),
            "none": np.full(800, np.nan),
            "same": np.full(800, 3.0),
        }
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.6, 0.95, 1.0]
    found = exact_quantiles(spark.createDataFrame(pdf), {c: probs for c in pdf})
    for column, values in found.items():
        expected = pdf[column].quantile(probs).tolist()
        if column == "none":
            assert values == [None] * len(probs)
        else:
            assert values == pytest.approx(expected), column
    nearest = exact_quantiles(spark.createDataFrame(pdf), {"smooth": [0.95]}, nearest=True)["smooth"][0]
    assert nearest == sorted(pdf.smooth)[math.ceil(0.95 * 800) - 1]


def test_grouped_median_matches_pandas(spark, size):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(rng.random(900) < 0.5, 0, rng.integers(1, 40, 900)), "x": rng.integers(0, 50, 900).astype(float)})
    pdf.loc[pdf.k == 7, "x"] = np.nan
    from pyspark.sql import functions as F

    found = {r["k"]: r["m"] for r in rows(grouped_median(spark.createDataFrame(pdf), ["k"], F.nullif("x", F.lit(float("nan"))), "m"))}
    for k, value in pdf.groupby("k").x.median().items():
        assert found[k] == (None if np.isnan(value) else value)


def test_correlation(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=200) + 1e6, "b": rng.normal(size=200), "gap": rng.normal(size=200), "flat": 4.0, "t": "x"})
    pdf["b"] += pdf.a - 1e6
    pdf.loc[::3, "gap"] = np.nan
    table = {(r["column_a"], r["column_b"]): r["correlation"] for r in rows(stats.correlation_analysis(spark.createDataFrame(pdf)))}
    expected = pdf[["a", "b", "gap", "flat"]].corr()
    assert len(table) == 16
    for (a, b), value in table.items():
        if "flat" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[a, b])
    assert rows(stats.correlation_analysis(spark.createDataFrame(pdf), ["a", "t"])) == []


def test_pairwise_constant_side(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, None), (4.0, None)], "a double, b double")
    table = {(r["column_a"], r["column_b"]): r["correlation"] for r in rows(stats.correlation_analysis(df))}
    assert table["a", "b"] is None and table["a", "a"] == 1.0


# --- quality --------------------------------------------------------------------------


def test_missing_and_duplicates(spark, size):
    cells = [("A", 10.0, 1, "x"), ("A", 20.0, 2, "y"), ("B", 30.0, 3, "z"), ("B", 40.0, 4, "z"), ("B", float("nan"), 5, "z")]
    df = spark.createDataFrame([*cells, cells[0]], "Category string, Revenue double, Orders long, Text string")
    missing = by(quality.get_missing_values(df), "column")
    assert missing["Revenue"]["missing"] == 1 and missing["Revenue"]["missing_percent"] == 16.67 and missing["Revenue"]["has_missing"]
    assert not missing["Text"]["has_missing"]
    assert only(quality.get_duplicate_rows(df)) == {"duplicate_rows": 1, "duplicate_percent": 16.67}
    overview = only(quality.get_dataset_overview(df))
    assert overview["rows"] == 6 and overview["columns"] == 4 and overview["duplicate_rows"] == 1
    assert overview["numeric_columns"] == ["Revenue", "Orders"] and overview["datetime_columns"] == []


def test_duplicates_treat_missing_as_equal(spark, size):
    df = spark.createDataFrame([(None, float("nan")), (None, None), (1, 2.0), (1, 2.0), (1, 2.0)], "a int, b double")
    assert only(quality.get_duplicate_rows(df))["duplicate_rows"] == 3
    empty = only(quality.get_duplicate_rows(df.limit(0)))
    assert empty == {"duplicate_rows": 0, "duplicate_percent": 0.0}


def test_duplicates_refuse_maps(spark):
    with pytest.raises(ValueError, match="map"):
        quality.get_duplicate_rows(spark.createDataFrame([({"a": 1},)], "m map<string,int>"))


def test_column_types(spark, size):
    pdf = pd.DataFrame(
        {
            "Order Date": ["2024-01-01", "2024-01-02", "2024-01-03"] * 40,
            "Name": [f"n{i}" for i in range(120)],
            "Segment": ["A", "A", None] * 40,
            "Revenue": range(120),
            "update note": ["soon", "later", "2024"] * 40,
        }
    )
    kinds = quality.infer_column_types(spark.createDataFrame(pdf))
    assert kinds == {"Order Date": "datetime", "Name": "text", "Segment": "categorical", "Revenue": "numeric", "update note": "categorical"}


def test_profile(spark):
    df = spark.createDataFrame([("Shipped", 100.0), (None, 200.0), ("Cancelled", 300.0)], "Status string, Revenue double")
    profile = quality.profile_dataframe(df)
    values = [r["value"] for r in rows(profile["categorical_summary"])]
    assert "<missing>" in values
    numbers = only(profile["numeric_summary"])
    assert (numbers["count"], numbers["mean"], numbers["std"], numbers["p25"], numbers["max"]) == (3, 200.0, 100.0, 150.0, 300.0)
    tips = [r["recommendation"] for r in rows(profile["recommendations"].orderBy("position"))]
    assert tips == ["Compare Revenue by Status using a bar chart.", "Review high-missing columns: Status."]


def test_numeric_distributions(spark, size):
    df = spark.createDataFrame([(1, "x", 2.0), (3, "y", float("nan")), (8, "z", 4.0)], "a int, t string, b double")
    table = by(quality.generic_numeric_distributions(df), "column")
    assert table["a"] == {"column": "a", "mean": 4.0, "median": 3.0, "min": 1.0, "max": 8.0, "missing": 0}
    assert table["b"]["median"] == 3.0 and table["b"]["missing"] == 1
    assert rows(quality.generic_numeric_distributions(df.select("t"))) == []


def test_top_categorical_values(spark):
    pdf = pd.DataFrame({"few": ["a", "b", None, "a"] * 30, "many": [f"v{i}" for i in range(120)], "one": ["k"] * 120, "n": range(120)})
    table = rows(quality.generic_top_categorical_values(spark.createDataFrame(pdf)))
    assert [(r["column"], r["unique"], r["value"], r["count"]) for r in table] == [("few", 2, "a", 60), ("few", 2, "b", 30), ("few", 2, None, 30)]


# --- charts ---------------------------------------------------------------------------


def test_charts(spark):
    df = spark.createDataFrame([("a", "2024-01-05", 1.0), ("a", "2024-01-09", 2.0), (None, "2024-02-01", 9.0), ("b", "x", 4.0)], "k string, d string, v double")
    assert rows(charts.chart_data(df, "bar", "k")) == [{"k": "a", "count": 2}, {"k": "b", "count": 1}]
    assert rows(charts.chart_data(df, "bar", "k", "v")) == [{"k": None, "v": 9.0}, {"k": "b", "v": 4.0}, {"k": "a", "v": 3.0}]
    assert rows(charts.chart_data(df, "line", "d", "v")) == [{"d": "2024-01", "v": 3.0}, {"d": "2024-02", "v": 9.0}]
    assert len(rows(charts.chart_data(df, "scatter", "d", "v"))) == 4
    bins = rows(charts.chart_data(df, "histogram", "v", bins=4))
    assert [(r["bin"], r["count"]) for r in bins] == [(0, 2), (1, 1), (3, 1)] and bins[0]["bin_low"] == 1.0 and bins[-1]["bin_high"] == 9.0
    flat = rows(charts.chart_data(df.where("v = 4"), "histogram", "v"))
    assert [(r["bin"], r["count"]) for r in flat] == [(0, 1)]
    box = only(charts.chart_data(df, "box", "v"))
    assert (box["q1"], box["median"], box["q3"], box["upper_whisker"], box["outliers"]) == (1.75, 3.0, 5.25, 9.0, 0)
    for bad in (("line", "d", None), ("pie", "k", "v"), ("bar", "zz", None)):
        with pytest.raises(ValueError):
            charts.chart_data(df, *bad)


# --- no cut before a filter, strict numbers, sums beyond a long ------------------------


def test_attrition_filters_before_it_ranks(spark):
    from colonnade.operators import domain
    from colonnade.plans.roles import profile_of

    small = [(f"g{i}", "Yes") for i in range(600)]
    df = spark.createDataFrame(small + [("big", "Yes")] * 90 + [("big", "No")] * 10, "department string, attrition string")
    table = rows(domain.hr_attrition_by_role(df, profile_of("hr", target="attrition", department="department"), min_rows=40))
    assert [(r["department"], r["rows"], r["positive_rate"]) for r in table] == [("big", 100, 0.9)]


def test_numbers_in_text_are_decimal(spark):
    from colonnade.functions.columns import money, number
    from pyspark.sql import functions as F

    texts = ["12d", "3F", "0x1p3", " 12 ", "1e3", "-.5", "7.", "", "NaN", "inf", "1_0", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(number(df, "t")).collect()] == [None, None, None, 12.0, 1000.0, -0.5, 7.0, None, None, float("inf"), None, None]
    cash = spark.createDataFrame([("$1.5B",), ("12d",), ("$3K",)], "t string")
    assert [r[0] for r in cash.select(money(F.col("t"))).collect()] == [1.5e9, None, 3000.0]


def test_sums_beyond_a_long(spark):
    from colonnade.operators.grouped import groupby_aggregate

    df = spark.createDataFrame([("a", 2**62)] * 3 + [("b", 1)], "k string, v long")
    assert [list(r)[:2] for r in groupby_aggregate(df, "k", "v", "sum").collect()] == [["a", 3.0 * 2**62], ["b", 1.0]]


def test_whole_numbers_without_exceptions(spark):
    from colonnade.sources.tables import infer_types

    df = spark.createDataFrame([("1", "9223372036854775807", "9223372036854775808", "x", "True"), ("-2", "-9223372036854775808", "1", "2", "false")], "a string, b string, c string, d string, e string")
    out = infer_types(df)
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "double", "string", "boolean"]
    assert [r.b for r in out.collect()] == [2**63 - 1, -(2**63)] and [r.e for r in out.collect()] == [True, False]


def test_types_look_at_all_rows(spark):
    from colonnade.operators.quality import infer_column_types

    texts = [f"2024-01-{1 + i % 28:02d}" for i in range(200)] + [f"code {i}" for i in range(1800)]
    df = spark.createDataFrame([(t,) for t in texts], "created_date string").repartition(7)
    assert infer_column_types(df) == {"created_date": "text"}


def test_whole_numbers_add_up_exactly(spark):
    """Above 2^53 digit by digit, above 2^63 without an overflow."""
    from colonnade.operators import domain, grouped, semantic
    from colonnade.plans.roles import profile_of

    big = spark.createDataFrame([("a", 2**60), ("a", 1), ("a", 1), ("b", 2**62), ("b", 2**62), ("b", 2**62), ("c", None)], "k string, n long")
    expect = {"a": 2**60 + 2, "b": 3 * 2**62, "c": 0}
    assert {r["k"]: int(r["sum_n"]) for r in grouped.groupby_aggregate(big, "k", "n", "sum", limit=None).collect()} == expect
    profile = profile_of(revenue="n", category="k", profit="n")
    assert {r["k"]: int(r["n"]) for r in semantic.semantic_breakdown(big, profile, "category", limit=None).collect()} == expect
    losses = spark.createDataFrame([(str(i), -1.0, 5.0) for i in range(30)], "k string, p double, r double")
    made = profile_of(revenue="r", category="k", profit="p")
    assert domain.retail_loss_analysis(losses, made, limit=None).count() == 30 and domain.retail_loss_analysis(losses, made).count() == 20
    assert domain.retail_top_opportunities(losses, made, limit=None).count() == 30


def test_sums_of_keys_beyond_a_long(spark, tmp_path):
    """Keys whose weighted values no long holds, and whole decimals, add up digit by digit."""
    import catalogue
    from colonnade.operators import grouped

    keys = [(2_000_000 + i, 60_000 + i, i) for i in range(50)]
    lines = spark.createDataFrame([("A", "O", *k) for k in keys], "l_returnflag string, l_linestatus string, l_partkey long, l_suppkey long, l_orderkey long")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    catalogue.load()
    found = only(catalogue.QUERIES["groupby_sum_of_whole_numbers"](spark, str(tmp_path)))
    assert found["total"] == str(sum(p * 10**13 + o for p, _, o in keys))
    found = only(catalogue.QUERIES["breakdown_of_whole_numbers"](spark, str(tmp_path)))
    assert found["total"] == str(sum(s * 10**15 - o for _, s, o in keys))
    wide = spark.sql("SELECT 'a' AS k, CAST('12345678901234567890123' AS decimal(30,0)) AS n UNION ALL SELECT 'a', 1 UNION ALL SELECT 'b', NULL")
    assert {r["k"]: int(r["sum_n"]) for r in rows(grouped.groupby_aggregate(wide, "k", "n", "sum"))} == {"a": 12345678901234567890124, "b": 0}
