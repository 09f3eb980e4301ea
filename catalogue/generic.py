"""Generic operators: grouping, comparison, series, ranking and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.views import table
from colonnade.operators import charts, compare, grouped, metrics, ranking, series, stats
from colonnade.operators.semantic import semantic_breakdown
from colonnade.plans.roles import profile_of


# --- groupby_aggregate ----------------------------------------------------------------

AGGREGATE_SQL = {
    "sum": "sum(l_extendedprice)",
    "mean": "avg(l_extendedprice)",
    "median": "median(l_extendedprice)",
    "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)",
    "count": "count(l_extendedprice)",
}


def _register_aggregation(how: str) -> None:
    @query(
        f"groupby_{how}",
        f"""SELECT l_suppkey, {AGGREGATE_SQL[how]} AS {how}_l_extendedprice FROM lineitem GROUP BY l_suppkey
        ORDER BY {how}_l_extendedprice DESC, l_suppkey LIMIT 50""",
    )
    def _(spark, sf):
        return grouped.groupby_aggregate(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", how)


for _how in AGGREGATE_SQL:
    _register_aggregation(_how)


# --- statistics -----------------------------------------------------------------------

CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "constant"]


def _correlation_sql() -> str:
    source = "(SELECT *, 7 AS constant FROM lineitem)"
    rows = []
    for a in CORRELATED:
        for b in CORRELATED:
            if "constant" in (a, b):
                value = "NULL"
            else:
                value = "1.0" if a == b else f"corr({a}, {b})"
            rows.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({value} AS DOUBLE) AS correlation FROM {source}")
    # one row per pair: an aggregate-free select would repeat the constant
    rows = [r if "corr(" in r else r.replace(f" FROM {source}", "") for r in rows]
    return " UNION ALL ".join(rows)


@query("correlation_analysis", _correlation_sql())
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("constant", F.lit(7))
    return stats.correlation_analysis(lines, [*CORRELATED, "l_returnflag"])


OUTLIER_SQL = """
WITH x AS (SELECT o_totalprice * (CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE 1 END) AS price FROM orders),
b AS (SELECT {low} AS lower, {high} AS upper FROM x)
SELECT 'price' AS metric_column, '{method}' AS method, count(CASE WHEN price < lower OR price > upper THEN 1 END) AS outliers_count,
round_even(count(CASE WHEN price < lower OR price > upper THEN 1 END) * 100.0 / count(*), 2) AS outliers_percent,
min(lower) AS lower, min(upper) AS upper FROM x, b
"""
Q1, Q3 = "quantile_cont(price, 0.25)", "quantile_cont(price, 0.75)"


def _spiked_orders(spark, sf):
    factor = F.when(F.col("o_orderkey") % 97 == 0, 9).otherwise(1)
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * factor).alias("price"))


@query("outliers_iqr", OUTLIER_SQL.format(method="iqr", low=f"{Q1} - 1.5 * ({Q3} - {Q1})", high=f"{Q3} + 1.5 * ({Q3} - {Q1})"))
def _(spark, sf):
    return stats.detect_outliers(_spiked_orders(spark, sf), "price", "iqr")


@query("outliers_zscore", OUTLIER_SQL.format(method="zscore", low="avg(price) - 3 * stddev_samp(price)", high="avg(price) + 3 * stddev_samp(price)"))
def _(spark, sf):
    return stats.detect_outliers(_spiked_orders(spark, sf), "price", "zscore")


@query(
    "outlier_rows",
    f"""WITH x AS (SELECT o_orderkey, o_totalprice * (CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE 1 END) AS price FROM orders),
    b AS (SELECT {Q1} - 1.5 * ({Q3} - {Q1}) AS lower, {Q3} + 1.5 * ({Q3} - {Q1}) AS upper FROM x)
    SELECT o_orderkey, price FROM x, b WHERE price < lower OR price > upper""",
)
def _(spark, sf):
    return stats.outlier_rows(_spiked_orders(spark, sf), "price", limit=None)


# --- series ---------------------------------------------------------------------------

LABELS = {
    "D": "strftime({d}, '%Y-%m-%d')",
    "M": "strftime({d}, '%Y-%m')",
    "Q": "concat(CAST(year({d}) AS VARCHAR), 'Q', CAST(quarter({d}) AS VARCHAR))",
    "Y": "strftime({d}, '%Y')",
}


def _register_trend(freq: str, how: str) -> None:
    label = LABELS[freq].format(d="o_orderdate")
    value = {"sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "count": "count(o_totalprice)", "median": "median(o_totalprice)"}[how]

    @query(
        f"trend_{how}_{freq.lower()}",
        f"""WITH g AS (SELECT {label} AS period, {value} AS metric_value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
        c AS (SELECT period, metric_value, (metric_value - lag(metric_value) OVER w) * 100.0 / nullif(lag(metric_value) OVER w, 0) AS pct_change
              FROM g WINDOW w AS (ORDER BY period))
        SELECT *, round_even((SELECT avg(pct_change) FROM c), 2) AS average_growth_rate FROM c""",
    )
    def _(spark, sf):
        return series.trend_analysis(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", freq, how)


for _freq, _how in (("M", "sum"), ("Q", "mean"), ("Y", "count"), ("D", "sum"), ("M", "median")):
    _register_trend(_freq, _how)


ANOMALY_SQL = """
WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS period, sum(value) AS metric_value FROM events GROUP BY 1),
s AS (SELECT avg(metric_value) AS mean, stddev_samp(metric_value) AS std FROM g)
SELECT period, metric_value, (metric_value - mean) / std AS z_score{flag}, mean, std FROM g, s {where}
"""


@query("anomaly_periods", ANOMALY_SQL.format(flag=", abs((metric_value - mean) / std) > 1.96 AS is_anomaly", where=""))
def _(spark, sf):
    return series.anomaly_periods(table(spark, sf, "events"), "ts", "value", "D")


@query("anomaly_detection", ANOMALY_SQL.format(flag="", where="WHERE abs((metric_value - mean) / std) > 1.0"))
def _(spark, sf):
    return series.anomaly_detection(table(spark, sf, "events"), "ts", "value", "D", 1.0)


@query(
    "forecast_next_period",
    """WITH RECURSIVE m AS (
      SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1
    ), r AS (SELECT *, row_number() OVER (ORDER BY month) AS i FROM m),
    smooth AS (
      SELECT i, v AS level FROM r WHERE i = 1 UNION ALL
      SELECT r.i, 0.3 * r.v + 0.7 * s.level FROM smooth s JOIN r ON r.i = s.i + 1
    ), f AS (
      SELECT (SELECT level FROM smooth ORDER BY i DESC LIMIT 1) AS level,
             (arg_max(v, i) - arg_min(v, i)) / (count(*) - 1) AS drift, max(month) AS last FROM r
    )
    SELECT strftime(last + to_months(CAST(k AS INTEGER)), '%Y-%m') AS period,
           round_even(greatest(level + drift * k, 0), 2) AS forecast_value
    FROM f, range(1, 7) t(k)""",
)
def _(spark, sf):
    return series.forecast_next_period(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 6)


@query(
    "cohort_summary",
    """WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1),
    g AS (SELECT date_trunc('month', first) AS c, date_trunc('month', o_orderdate) AS a, count(DISTINCT o_custkey) AS users
          FROM orders JOIN f USING (o_custkey) GROUP BY 1, 2),
    s AS (SELECT *, max(CASE WHEN a = c THEN users END) OVER (PARTITION BY c) AS cohort_size FROM g WHERE a >= c)
    SELECT strftime(c, '%Y-%m') AS cohort_period, strftime(a, '%Y-%m') AS activity_period, users,
    CAST(date_diff('month', c, a) AS INTEGER) AS cohort_lifetime, cohort_size,
    round_even(users * 100.0 / cohort_size, 2) AS retention_rate FROM s""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    return series.cohort_summary(orders.join(first, "o_custkey"), "first_order", "o_orderdate", "o_custkey")


# --- comparison -----------------------------------------------------------------------

PERIODS = ("1997-01-01", "1997-06-30", "1996-01-01", "1996-06-30")
IN_A, IN_B = (f"l_shipdate BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in (PERIODS[:2], PERIODS[2:]))


def _register_segments(how: str, function: str) -> None:
    @query(
        f"compare_segments_{how}",
        f"""WITH s AS (
          SELECT coalesce({function}(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END), 0.0) AS value_a,
                 coalesce({function}(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 0.0) AS value_b FROM customer)
        SELECT 'c_mktsegment' AS segment_column, 'BUILDING' AS segment_a, 'MACHINERY' AS segment_b, 'c_acctbal' AS metric_column,
        '{how}' AS aggregation, CAST(value_a AS DOUBLE) AS value_a, CAST(value_b AS DOUBLE) AS value_b,
        CAST(value_a - value_b AS DOUBLE) AS absolute_difference,
        round_even(CAST(coalesce((value_a - value_b) / nullif(value_b, 0) * 100, 0) AS DOUBLE), 2) AS percentage_difference FROM s""",
    )
    def _(spark, sf):
        customers = table(spark, sf, "customer")
        return compare.compare_segments(customers, "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal", how).drop("conclusion")


for _how, _function in (("mean", "avg"), ("sum", "sum"), ("median", "median"), ("count", "count")):
    _register_segments(_how, _function)


@query(
    "period_over_period_change",
    f"""WITH s AS (SELECT coalesce(sum(CASE WHEN {IN_A} THEN l_extendedprice END), 0.0) AS value_a,
    coalesce(sum(CASE WHEN {IN_B} THEN l_extendedprice END), 0.0) AS value_b FROM lineitem)
    SELECT 'l_shipdate' AS date_column, 'l_extendedprice' AS metric_column, '{PERIODS[0]}' AS period_a_start, '{PERIODS[1]}' AS period_a_end,
    value_a, '{PERIODS[2]}' AS period_b_start, '{PERIODS[3]}' AS period_b_end, value_b, value_a - value_b AS absolute_difference,
    round_even((value_a - value_b) / value_b * 100, 2) AS percentage_difference FROM s""",
)
def _(spark, sf):
    return compare.period_over_period_change(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", *PERIODS)


def _register_explain(how: str, function: str) -> None:
    changes = f"""WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS dimension_value,
    coalesce({function}(CASE WHEN {IN_A} THEN l_extendedprice END), 0.0) AS value_period_a,
    coalesce({function}(CASE WHEN {IN_B} THEN l_extendedprice END), 0.0) AS value_period_b
    FROM lineitem WHERE {IN_A} OR {IN_B} GROUP BY l_suppkey),
    d AS (SELECT *, value_period_a - value_period_b AS absolute_change FROM g)"""

    @query(
        f"explain_metric_change_{how}",
        f"""{changes} SELECT *, round_even(coalesce(absolute_change / nullif((SELECT sum(absolute_change) FROM d), 0) * 100, 0), 2)
        AS contribution_to_change_percent FROM d""",
    )
    def _(spark, sf):
        lines = table(spark, sf, "lineitem")
        return compare.explain_metric_change(lines, "l_shipdate", "l_extendedprice", "l_suppkey", *PERIODS, how)

    @query(
        f"explain_metric_change_totals_{how}",
        f"""{changes}, t AS (SELECT sum(value_period_a) AS period_a_total, sum(value_period_b) AS period_b_total FROM d)
        SELECT *, period_a_total - period_b_total AS absolute_change,
        round_even((period_a_total - period_b_total) / period_b_total * 100, 2) AS percentage_change FROM t""",
    )
    def _(spark, sf):
        lines = table(spark, sf, "lineitem")
        return compare.explain_metric_change_totals(lines, "l_shipdate", "l_extendedprice", "l_suppkey", *PERIODS, how)


for _how, _function in (("sum", "sum"), ("median", "median")):
    _register_explain(_how, _function)


# --- ranking --------------------------------------------------------------------------


@query(
    "top_bottom_contributors",
    """WITH g AS (SELECT o_custkey, sum(o_totalprice) AS total_value FROM orders GROUP BY o_custkey),
    r AS (SELECT *, row_number() OVER (ORDER BY total_value DESC, o_custkey) AS t, row_number() OVER (ORDER BY total_value, o_custkey DESC) AS b,
          sum(total_value) OVER () AS total_sum FROM g)
    SELECT 'top' AS side, t AS position, o_custkey, total_value, round_even(total_value / total_sum * 100, 2) AS contribution_percent, total_sum FROM r WHERE t <= 5
    UNION ALL SELECT 'bottom', b, o_custkey, total_value, round_even(total_value / total_sum * 100, 2), total_sum FROM r WHERE b <= 5""",
)
def _(spark, sf):
    return ranking.top_bottom_contributors(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 5)


PARETO_SQL = """
WITH g AS (SELECT {key}, sum({value}) AS total_value FROM {source} GROUP BY {key}),
c AS (SELECT *, sum(total_value) OVER (ORDER BY total_value DESC, {key} ROWS UNBOUNDED PRECEDING) AS cumulative_value,
      sum(total_value) OVER () AS total_sum, count(*) OVER () AS total_categories,
      row_number() OVER (ORDER BY total_value DESC, {key}) AS rn FROM g),
p AS (SELECT {key}, total_value, cumulative_value, round_even(cumulative_value / total_sum * 100, 2) AS cumulative_percent, total_sum, total_categories, rn FROM c),
k AS (SELECT * FROM p WHERE cumulative_percent <= 80 OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE cumulative_percent <= 80)))
SELECT * EXCLUDE (rn), count(*) OVER () AS contributors_count,
round_even(count(*) OVER () * 100.0 / total_categories, 2) AS categories_percent FROM k
"""


@query("pareto_analysis", PARETO_SQL.format(key="l_partkey", value="l_extendedprice", source="lineitem"))
def _(spark, sf):
    return ranking.pareto_analysis(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice")


@query("pareto_first_exceeds", PARETO_SQL.format(key="kind", value="price", source="(SELECT CASE WHEN o_orderstatus = 'P' THEN 'some' ELSE 'most' END AS kind, o_totalprice AS price FROM orders WHERE o_orderpriority <> '9')"))
def _(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "P", "some").otherwise("most")
    orders = table(spark, sf, "orders").select(kind.alias("kind"), F.col("o_totalprice").alias("price"))
    return ranking.pareto_analysis(orders, "kind", "price")


# --- user metrics ---------------------------------------------------------------------

METRIC_PROFILE = profile_of("retail", revenue="l_extendedprice", discount="l_discount", quantity="l_quantity", category="l_returnflag")
UNIT_PRICE = {"name": "net_unit_price", "expression": "revenue * (1 - discount) / (quantity - 1)", "required_roles": ["revenue"]}
UNIT_SQL = "l_extendedprice * (1 - l_discount) / nullif(l_quantity - 1, 0)"


def _register_metric(how: str, function: str) -> None:
    @query(
        f"metric_summary_{how}",
        f"""SELECT 'net_unit_price' AS name, '{how}' AS aggregation, CAST({function}({UNIT_SQL}) AS DOUBLE) AS value, count({UNIT_SQL}) AS valid_count,
        count(*) - count({UNIT_SQL}) AS missing_count, 'series' AS result_type FROM lineitem""",
    )
    def _(spark, sf):
        summary = metrics.evaluate_metric_summary(table(spark, sf, "lineitem"), METRIC_PROFILE, {**UNIT_PRICE, "aggregation": how})
        return summary.select("name", "aggregation", "value", "valid_count", "missing_count", "result_type")


for _how, _function in (("mean", "avg"), ("median", "median"), ("sum", "sum"), ("max", "max")):
    _register_metric(_how, _function)


@query(
    "metric_share_of_total",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * 100 / (SELECT sum(l_extendedprice) FROM lineitem) - (SELECT avg(l_discount) FROM lineitem) AS share
    FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    term = metrics.compile_metric(lines, METRIC_PROFILE, {"name": "share", "expression": "100 * revenue / sum(revenue) - mean(discount)"})
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", term.column.alias("share"))


@query(
    "metric_scalar_summary",
    """SELECT 'rate' AS name, sum(l_discount) / sum(l_quantity) + count(l_tax) AS value, 1::BIGINT AS valid_count, 0::BIGINT AS missing_count,
    'scalar' AS result_type FROM lineitem""",
)
def _(spark, sf):
    metric = {"name": "rate", "expression": "safe_div(sum(discount), sum(quantity)) + count(l_tax)"}
    summary = metrics.evaluate_metric_summary(table(spark, sf, "lineitem"), METRIC_PROFILE, metric)
    return summary.select("name", "value", "valid_count", "missing_count", "result_type")


@query(
    "metric_breakdown",
    f"SELECT l_suppkey, avg({UNIT_SQL}) AS net_unit_price FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, l_suppkey LIMIT 20",
)
def _(spark, sf):
    return metrics.metric_breakdown(table(spark, sf, "lineitem"), METRIC_PROFILE, UNIT_PRICE, by_column="l_suppkey")


@query(
    "metric_breakdown_lowest",
    f"SELECT l_returnflag, median({UNIT_SQL}) AS net_unit_price FROM lineitem GROUP BY l_returnflag ORDER BY 2, l_returnflag LIMIT 20",
)
def _(spark, sf):
    metric = {**UNIT_PRICE, "aggregation": "median", "higher_is_better": False}
    return metrics.metric_breakdown(table(spark, sf, "lineitem"), METRIC_PROFILE, metric, by_role="category")


# --- chart data -----------------------------------------------------------------------


@query("chart_bar_count", "SELECT l_suppkey, count(*) AS count FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return charts.chart_data(table(spark, sf, "lineitem"), "bar", "l_suppkey")


@query("chart_bar_sum", "SELECT l_partkey, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return charts.chart_data(table(spark, sf, "lineitem"), "bar", "l_partkey", "l_extendedprice")


@query("chart_line", "SELECT strftime(l_shipdate, '%Y-%m') AS l_shipdate, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return charts.chart_data(table(spark, sf, "lineitem"), "line", "l_shipdate", "l_quantity")


@query("chart_scatter", "SELECT l_quantity, l_extendedprice FROM lineitem")
def _(spark, sf):
    return charts.chart_data(table(spark, sf, "lineitem"), "scatter", "l_quantity", "l_extendedprice")


@query(
    "chart_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, lo, (hi - lo) / 50 AS w FROM lineitem, e)
    SELECT bin, min(lo) + bin * min(w) AS bin_low, min(lo) + (bin + 1) * min(w) AS bin_high, count(*) AS count FROM b GROUP BY bin""",
)
def _(spark, sf):
    return charts.chart_data(table(spark, sf, "lineitem"), "histogram", "l_extendedprice")


@query(
    "chart_box",
    """WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer),
    x AS (SELECT c_acctbal AS v, q1, m, q3, c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM customer, q)
    SELECT min(v) AS min, min(CASE WHEN inside THEN v END) AS lower_whisker, min(q1) AS q1, min(m) AS median, min(q3) AS q3,
    max(CASE WHEN inside THEN v END) AS upper_whisker, max(v) AS max, count(CASE WHEN NOT inside THEN 1 END) AS outliers FROM x""",
)
def _(spark, sf):
    return charts.chart_data(table(spark, sf, "customer"), "box", "c_acctbal")


@query(
    "groupby_sum_of_whole_numbers",
    """SELECT l_returnflag, CAST(sum(CAST(l_partkey AS HUGEINT) * 10000000000000 + l_orderkey) AS VARCHAR) AS total FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    """Sums far above what a double or a long holds, digit by digit."""
    big = F.col("l_partkey").cast("decimal(20,0)") * F.lit(10000000000000) + F.col("l_orderkey")
    lines = table(spark, sf, "lineitem").select("l_returnflag", big.alias("big"))
    found = grouped.groupby_aggregate(lines, "l_returnflag", "big", "sum", limit=None)
    return found.select("l_returnflag", F.col("sum_big").cast("string").alias("total"))


@query(
    "breakdown_of_whole_numbers",
    """SELECT l_linestatus, CAST(sum(CAST(l_suppkey AS HUGEINT) * 1000000000000000 - l_orderkey) AS VARCHAR) AS total FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    big = F.col("l_suppkey").cast("decimal(20,0)") * F.lit(1000000000000000) - F.col("l_orderkey")
    lines = table(spark, sf, "lineitem").select("l_linestatus", big.alias("big"))
    found = semantic_breakdown(lines, profile_of(revenue="big", category="l_linestatus"), "category", limit=None)
    return found.select("l_linestatus", F.col("big").cast("string").alias("total"))
