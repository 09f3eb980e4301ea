"""Every catalogue query against its SQL on the smallest data, and the shape of some plans."""

from __future__ import annotations

import io
import os
import re
from contextlib import redirect_stdout

import duckdb
import pytest

import __spark_entry__ as entry
import catalogue
import compare_oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for name in compare_oracle.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    outcome = compare_oracle.compare(spark, connection, SF, name)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def plan(spark, name: str) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        entry.queries()[name](spark, SF).explain("formatted")
    return text.getvalue()


def test_period_filter_reaches_the_scan(spark):
    text = plan(spark, "period_over_period_change")
    assert re.search(r"PushedFilters: \[.*l_shipdate.*1996-01-01", text)
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "revenue_by_month")
    assert "l_partkey" not in text and "l_tax" not in text and "part.parquet" not in text


def test_frequent_values_are_cut_before_the_shuffle(spark):
    assert plan(spark, "value_frequencies").count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["top_skus_by_revenue", "top_bottom_contributors", "groupby_sum", "semantic_breakdown"])
def test_top_lists_need_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["top_bottom_contributors", "pareto_analysis", "explain_metric_change_sum", "best_matches", "revenue_by_category"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_both_cancellation_tables_come_from_one_scan(spark):
    assert plan(spark, "cancellation_by_dimension").count("lineitem.parquet") == 1


def test_grand_total_does_not_gather_groups_in_a_window(spark):
    text = plan(spark, "explain_metric_change_sum")
    assert "Subquery" in text and not re.search(r"\bWindow\b", text)
