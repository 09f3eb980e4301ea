from __future__ import annotations

import datetime as dt

import pytest

from colonnade.operators import cleaning, grouped, quality
from tests.conftest import by, only, rows

SCHEMA = (
    "order_id string, date timestamp, order_month string, category string, sku string, size string, ship_state string, "
    "ship_city string, fulfilment string, courier_status string, has_promotion boolean, b2b boolean, qty long, "
    "amount double, revenue double, is_cancelled boolean"
)


@pytest.fixture(scope="module")
def lines(spark):
    day = lambda m, d: dt.datetime(2022, m, d)
    return spark.createDataFrame(
        [
            ("o1", day(4, 1), "2022-04", "Set", "s1", "M", "A", "Alpha", "Amazon", "Shipped", True, False, 1, 100.0, 100.0, False),
            ("o2", day(4, 2), "2022-04", "Set", "s2", "L", "A", "Alpha", "Merchant", None, False, False, 2, 200.0, 200.0, True),
            ("o3", day(5, 1), "2022-05", "Kurta", "k1", "M", "B", "Beta", "Amazon", "Cancelled", False, False, 1, None, None, False),
            ("o4", day(5, 2), "2022-05", "Kurta", "k1", "M", "B", "Beta", "Merchant", "Shipped", True, True, 1, 400.0, 400.0, False),
        ],
        SCHEMA,
    )


def test_overview(lines):
    overview = only(grouped.get_sales_overview(lines))
    assert overview["total_revenue"] == 700.0
    assert overview["missing_amount_rows"] == 1 and overview["missing_amount_percent"] == 25.0
    assert overview["unique_orders"] == 4 and overview["rows"] == 4 and overview["columns"] == 16
    assert overview["cancel_rate"] == 0.25 and overview["total_qty"] == 5
    assert (overview["date_min"], overview["date_max"]) == ("2022-04-01", "2022-05-02")
    assert overview["notes"][-1] == "1 rows have missing amount."


def test_overview_of_nothing(lines):
    overview = only(grouped.get_sales_overview(lines.limit(0)))
    assert overview["rows"] == 0 and overview["total_revenue"] == 0.0 and overview["cancel_rate"] == 0.0
    assert overview["missing_amount_percent"] == 0.0 and overview["date_min"] is None and len(overview["notes"]) == 2


def test_data_quality(lines):
    summary = only(quality.get_data_quality_summary(lines))
    assert summary["duplicate_rows"] == 0 and summary["duplicate_order_id_rows"] == 0
    assert summary["warnings"] == ["1 rows have missing amount; revenue is calculated from available values."]
    again = only(quality.get_data_quality_summary(lines.union(lines)))
    assert again["duplicate_rows"] == 4 and again["duplicate_order_id_rows"] == 4 and len(again["warnings"]) == 3


def test_months_and_categories(lines):
    months = by(grouped.revenue_by_month(lines), "order_month")
    assert months["2022-04"]["revenue"] == 300.0 and months["2022-04"]["orders"] == 2
    assert months["2022-05"]["revenue"] == 400.0
    kinds = by(grouped.revenue_by_category(lines), "category")
    assert kinds["Set"]["revenue"] == 300.0 and kinds["Kurta"]["revenue"] == 400.0
    assert kinds["Kurta"]["orders"] == 2 and kinds["Kurta"]["avg_amount"] == 400.0
    assert kinds["Set"]["revenue_share"] == 42.86 and kinds["Kurta"]["revenue_share"] == 57.14


def test_share_of_zero_total(spark, lines):
    from pyspark.sql import functions as F

    free = lines.withColumn("revenue", F.lit(None).cast("double"))
    assert {r["revenue_share"] for r in rows(grouped.revenue_by_category(free))} == {0.0}
    assert {r["revenue"] for r in rows(grouped.revenue_by_category(free))} == {0.0}


def test_top_lists(lines):
    assert rows(grouped.top_states_by_revenue(lines, 1))[0]["ship_state"] == "B"
    first = rows(grouped.top_skus_by_revenue(lines, 2))[0]
    assert first["sku"] == "k1" and first["revenue"] == 400.0 and first["category"] == "Kurta"
    assert rows(grouped.top_cities_by_revenue(lines, 1))[0]["ship_city"] == "Beta"
    worst = only(grouped.state_cancellation_summary(lines, min_orders=2, n=1))
    assert worst["ship_state"] == "A" and worst["cancel_rate"] == 0.5 and worst["cancelled_rows"] == 1
    for bad in (0, 101):
        with pytest.raises(ValueError):
            grouped.top_states_by_revenue(lines, bad)
    with pytest.raises(ValueError):
        grouped.state_cancellation_summary(lines, min_orders=-1)


def test_single_dimension_tables(lines):
    sizes = by(grouped.revenue_by_size(lines), "size")
    assert sizes["M"]["revenue"] == 500.0 and sizes["L"]["revenue"] == 200.0
    risk = by(grouped.category_cancellation_summary(lines), "category")
    assert risk["Set"]["cancelled_rows"] == 1 and risk["Set"]["cancel_rate"] == 0.5
    channels = by(grouped.fulfilment_summary(lines), "fulfilment")
    assert channels["Merchant"]["revenue"] == 600.0 and channels["Amazon"]["orders"] == 2
    couriers = by(grouped.courier_summary(lines), "courier_status")
    assert couriers[None]["rows"] == 1 and couriers["Shipped"]["rows"] == 2
    promotions = rows(grouped.promotion_summary(lines))
    assert len(promotions) == 2 and all("not causal" in r["warning"] for r in promotions)


def test_b2b_caveat_depends_on_share(lines):
    assert {r["warning"] for r in rows(grouped.b2b_summary(lines))} == {None}
    from pyspark.sql import functions as F

    many = lines.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("order_id", F.concat("order_id", F.col("id").cast("string")))
    rare = many.withColumn("b2b", (F.col("id") == 0) & F.col("b2b"))
    assert all("small" in r["warning"] for r in rows(grouped.b2b_summary(rare)))


def test_cancellations(lines):
    overall = only(grouped.cancellation_summary(lines))
    assert overall == {"overall_cancel_rate": 0.25, "cancelled_rows": 1, "cancelled_orders": 1}
    parts = {(r["dimension"], r["group_value"]): r for r in rows(grouped.cancellation_by_dimension(lines))}
    assert len(parts) == 4
    assert parts["category", "Set"]["cancel_rate"] == 0.5 and parts["fulfilment", "Amazon"]["cancel_rate"] == 0.0


def test_null_group_in_grouping_sets(spark):
    df = spark.createDataFrame([("o1", True, None, "x"), ("o2", False, "c", None)], "order_id string, is_cancelled boolean, category string, fulfilment string")
    parts = [(r["dimension"], r["group_value"], r["rows"]) for r in rows(grouped.cancellation_by_dimension(df))]
    assert sorted(parts, key=str) == sorted([("category", None, 1), ("category", "c", 1), ("fulfilment", None, 1), ("fulfilment", "x", 1)], key=str)


def test_missing_columns_are_named(lines):
    with pytest.raises(ValueError, match="Missing required columns"):
        grouped.revenue_by_size(lines.drop("size"))


def test_order_line_summaries(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 1)], "order_id string, sku int")
    assert only(grouped.lines_per_order(df)) == {
        "unique_orders": 2, "multi_line_orders": 1, "max_lines_per_order": 2, "avg_lines_per_order": 1.5,
    }
    assert rows(grouped.lines_per_order_histogram(df)) == [{"lines": 1, "orders": 1}, {"lines": 2, "orders": 1}]
    assert len(rows(grouped.repeated_key_rows(df, ["order_id"]))) == 4
    assert len(rows(grouped.repeated_key_rows(df, ["order_id", "sku"]))) == 2


def test_largest_rows_and_frequencies(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", float("nan")), ("c", 5.0), (None, None), (None, 3.0)], "k string, x double")
    assert [(r["k"], r["x"]) for r in rows(grouped.largest_rows(df, "x", 2))] == [("c", 5.0), ("a", 3.0)]
    counts = {(r["column"], r["value"]): r["count"] for r in rows(grouped.value_frequencies(df, ["k", "x"]))}
    assert counts["k", None] == 2 and counts["x", "3.0"] == 2 and counts["x", None] == 2


def test_groupby_aggregate(spark):
    df = spark.createDataFrame(
        [("A", 10.0, 1, "x"), ("A", 20.0, 2, "y"), ("B", 30.0, 3, "z"), ("B", 40.0, 4, "z"), ("B", None, 5, "z")],
        "Category string, Revenue double, Orders long, Text string",
    )
    get = lambda metric, how: {r["Category"]: r[f"{how}_{metric}"] for r in rows(grouped.groupby_aggregate(df, "Category", metric, how))}
    assert get("Revenue", "sum") == {"B": 70.0, "A": 30.0}
    assert get("Revenue", "count") == {"B": 2, "A": 2}
    assert get("Orders", "mean") == {"B": 4.0, "A": 1.5}
    assert get("Revenue", "median") == {"B": 35.0, "A": 15.0}
    assert get("Text", "count") == {"B": 3, "A": 2}
    for arguments in (("Missing", "Revenue", "sum"), ("Category", "Revenue", "mode"), ("Category", "Text", "sum")):
        with pytest.raises(ValueError):
            grouped.groupby_aggregate(df, *arguments)
    with pytest.raises(ValueError):
        grouped.groupby_aggregate(df, "Category", "Revenue", "sum", limit=501)


def test_group_semantics_of_missing_values(spark, size):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (1.0, None), (1.0, float("nan"))], "k double, x double")
    for how, expected in (("sum", {None: 3.0, 1.0: 0.0}), ("mean", {None: 1.5, 1.0: None}), ("median", {None: 1.5, 1.0: None}), ("count", {None: 2, 1.0: 0})):
        assert {r["k"]: r[f"{how}_x"] for r in rows(grouped.groupby_aggregate(df, "k", "x", how))} == expected, how


# --- cleaning -------------------------------------------------------------------------


def test_clean_column_name():
    names = {"Order ID": "order_id", "Sales Channel ": "sales_channel", "ship-service-level": "ship_service_level", "Unnamed: 22": "unnamed_22"}
    assert {k: cleaning.clean_column_name(k) for k in names} == names


def test_clean_sales(spark):
    raw = spark.createDataFrame(
        [(0, "1", "04-30-22", "Amazon.in", "Hyderabad", "Telangana", "dress-set 3a", None), (1, "2", "12-31-98", " x ", None, "k", "KURTA", None), (2, "3", "never", "", "a", "b", "c", None)],
        "index int, `Order ID` string, Date string, `Sales Channel ` string, `ship-city` string, `ship-state` string, Category string, `Unnamed: 22` string",
    )
    clean = cleaning.clean_sales(raw)
    assert clean.columns == ["order_id", "date", "sales_channel", "ship_city", "ship_state", "category"]
    first, second, third = rows(clean.orderBy("order_id"))
    assert first["date"] == dt.datetime(2022, 4, 30) and second["date"] == dt.datetime(1998, 12, 31) and third["date"] is None
    assert (first["ship_city"], first["ship_state"], first["category"]) == ("HYDERABAD", "TELANGANA", "Dress-Set 3A")
    assert second["sales_channel"] == "x" and second["ship_city"] is None and second["category"] == "Kurta"


def test_features(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2022, 4, 30), "Cancelled", None, 100.0, 0), (dt.datetime(2022, 5, 1), "Shipped - Delivered to Buyer", "promo", 200.0, 2)],
        "date timestamp, status string, promotion_ids string, amount double, qty int",
    )
    first, second = rows(cleaning.add_sales_features(df).orderBy("date"))
    assert first["is_cancelled"] and second["is_shipped"] and second["is_delivered"] and not second["is_cancelled"]
    assert not first["has_promotion"] and second["has_promotion"]
    assert second["amount_per_item"] == 100.0 and first["amount_per_item"] is None
    assert (first["order_year"], first["order_month"], first["order_day"], first["order_day_name"]) == (2022, "2022-04", 30, "Saturday")


def test_features_without_optional_columns(spark):
    row = only(cleaning.add_sales_features(spark.createDataFrame([("Cancelled",)], "status string")))
    assert row["is_cancelled"] and not row["has_promotion"] and row["revenue"] is None and row["amount_per_item"] is None
    row = only(cleaning.add_sales_features(spark.createDataFrame([(1,)], "qty int")))
    assert row["status_clean"] == "" and not row["is_cancelled"]


def test_find_column(spark):
    df = spark.createDataFrame([(1, 2)], "`Metro / Regional` int, other int")
    assert cleaning.find_column(df, "nothing", "regional") == "Metro / Regional"
    with pytest.raises(ValueError):
        cleaning.find_column(df, "absent")
