"""Order-line tables: measures per group, cancellations, notebook-style summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.views import SALES_SQL, sales, table
from colonnade.functions.columns import number
from colonnade.operators import grouped, quality

REVENUE = "coalesce(sum(revenue), 0) AS revenue"
QTY = "CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty"
ORDERS = "count(DISTINCT order_id) AS orders"
CANCEL_RATE = "avg(cancelled) AS cancel_rate"
AVG_AMOUNT = "avg(revenue) AS avg_amount"
ROWS = "count(order_id) AS rows"
CANCELLED = "CAST(sum(cancelled) AS BIGINT) AS cancelled_rows"


def _sql(keys: str, measures: list[str], tail: str = "") -> str:
    return f"{SALES_SQL} SELECT {keys}, {', '.join(measures)} FROM sales GROUP BY {keys} {tail}"


@query(
    "sales_overview",
    f"""{SALES_SQL} SELECT count(*) AS rows, count(DISTINCT order_id) AS unique_orders,
    strftime(min(date), '%Y-%m-%d') AS date_min, strftime(max(date), '%Y-%m-%d') AS date_max,
    sum(revenue) AS total_revenue, CAST(sum(qty) AS BIGINT) AS total_qty, avg(cancelled) AS cancel_rate,
    count(*) - count(amount) AS missing_amount_rows,
    round_even((count(*) - count(amount)) * 100.0 / count(*), 2) AS missing_amount_percent FROM sales""",
)
def _(spark, sf):
    return grouped.get_sales_overview(sales(spark, sf)).drop("columns", "notes")


@query(
    "sales_data_quality",
    f"""{SALES_SQL}, thin AS (SELECT order_id, qty, amount, fulfilment, courier_status FROM sales)
    SELECT (SELECT count(*) FROM thin) - (SELECT count(*) FROM (SELECT DISTINCT * FROM thin)) AS duplicate_rows,
    (SELECT count(*) - count(DISTINCT order_id) FROM thin) AS duplicate_order_id_rows""",
)
def _(spark, sf):
    thin = sales(spark, sf, "orders").select("order_id", "qty", "amount", "fulfilment", "courier_status")
    return quality.get_data_quality_summary(thin).drop("warnings")


@query("revenue_by_month", _sql("order_month", [REVENUE, ORDERS, QTY, CANCEL_RATE]))
def _(spark, sf):
    return grouped.revenue_by_month(sales(spark, sf))


@query(
    "revenue_by_category",
    f"""{SALES_SQL} SELECT category, {REVENUE},
    round_even(coalesce(sum(revenue), 0) * 100 / (SELECT sum(revenue) FROM sales), 2) AS revenue_share,
    {QTY}, {ORDERS}, {CANCEL_RATE}, {AVG_AMOUNT} FROM sales GROUP BY category""",
)
def revenue_by_category(spark, sf):
    return grouped.revenue_by_category(sales(spark, sf, "part"))


@query(
    "top_states_by_revenue",
    _sql("ship_state", [REVENUE, ORDERS, QTY, CANCEL_RATE], "ORDER BY revenue DESC, ship_state LIMIT 10"),
)
def _(spark, sf):
    return grouped.top_states_by_revenue(sales(spark, sf, "customer"), 10)


@query(
    "top_skus_by_revenue",
    _sql("sku, category", [REVENUE, QTY, ORDERS, CANCEL_RATE, AVG_AMOUNT], "ORDER BY revenue DESC, sku, category LIMIT 20"),
)
def _(spark, sf):
    return grouped.top_skus_by_revenue(sales(spark, sf, "part"), 20)


@query("revenue_by_size", _sql("size", [REVENUE, QTY, ORDERS, CANCEL_RATE, AVG_AMOUNT]))
def _(spark, sf):
    return grouped.revenue_by_size(sales(spark, sf, "part"))


@query("category_cancellation_summary", _sql("category", [ROWS, ORDERS, CANCELLED, CANCEL_RATE, REVENUE]))
def _(spark, sf):
    return grouped.category_cancellation_summary(sales(spark, sf, "part"))


@query("fulfilment_summary", _sql("fulfilment", [REVENUE, QTY, ORDERS, CANCEL_RATE, AVG_AMOUNT]))
def _(spark, sf):
    return grouped.fulfilment_summary(sales(spark, sf))


@query("courier_summary", _sql("courier_status", [ROWS, REVENUE, QTY, ORDERS]))
def _(spark, sf):
    return grouped.courier_summary(sales(spark, sf, "orders"))


@query(
    "promotion_summary",
    f"""{SALES_SQL} SELECT has_promotion, {REVENUE}, {QTY}, {ORDERS}, {AVG_AMOUNT}, {CANCEL_RATE},
    '{grouped.PROMOTION_NOTE}' AS warning FROM sales GROUP BY has_promotion""",
)
def _(spark, sf):
    return grouped.promotion_summary(sales(spark, sf))


@query(
    "b2b_summary",
    f"""{SALES_SQL}, g AS (SELECT b2b, {REVENUE}, {QTY}, {ORDERS}, {AVG_AMOUNT}, {CANCEL_RATE} FROM sales GROUP BY b2b)
    SELECT *, CASE WHEN (SELECT sum(CASE WHEN b2b THEN orders ELSE 0 END) / sum(orders) FROM g) < 0.05
    THEN '{grouped.B2B_NOTE}' END AS warning FROM g""",
)
def _(spark, sf):
    return grouped.b2b_summary(sales(spark, sf, "customer"))


@query(
    "top_cities_by_revenue",
    _sql("ship_city, ship_state", [REVENUE, ORDERS, QTY, CANCEL_RATE], "ORDER BY revenue DESC, ship_city, ship_state LIMIT 20"),
)
def _(spark, sf):
    return grouped.top_cities_by_revenue(sales(spark, sf, "customer"), 20)


@query(
    "state_cancellation_summary",
    _sql(
        "ship_state",
        [ORDERS, REVENUE, CANCEL_RATE, CANCELLED],
        "HAVING count(DISTINCT order_id) >= 500 ORDER BY cancel_rate DESC, ship_state LIMIT 20",
    ),
)
def _(spark, sf):
    return grouped.state_cancellation_summary(sales(spark, sf, "customer"), min_orders=500, n=20)


@query(
    "cancellation_summary",
    f"""{SALES_SQL} SELECT avg(cancelled) AS overall_cancel_rate, CAST(sum(cancelled) AS BIGINT) AS cancelled_rows,
    count(DISTINCT CASE WHEN is_cancelled THEN order_id END) AS cancelled_orders FROM sales""",
)
def _(spark, sf):
    return grouped.cancellation_summary(sales(spark, sf))


@query(
    "cancellation_by_dimension",
    f"""{SALES_SQL} SELECT 'category' AS dimension, category AS group_value, {ROWS}, {ORDERS}, {CANCEL_RATE}
    FROM sales GROUP BY category UNION ALL
    SELECT 'fulfilment', fulfilment, {ROWS}, {ORDERS}, {CANCEL_RATE} FROM sales GROUP BY fulfilment""",
)
def _(spark, sf):
    return grouped.cancellation_by_dimension(sales(spark, sf, "part"))


# --- further summaries of the same lines ------------------------------------------


@query(
    "lines_per_order",
    """WITH s AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
    SELECT count(*) AS unique_orders, count(CASE WHEN lines > 1 THEN 1 END) AS multi_line_orders,
    max(lines) AS max_lines_per_order, avg(lines) AS avg_lines_per_order FROM s""",
)
def _(spark, sf):
    return grouped.lines_per_order(table(spark, sf, "lineitem"), "l_orderkey")


@query(
    "lines_per_order_histogram",
    """WITH s AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
    SELECT lines, count(*) AS orders FROM s GROUP BY lines""",
)
def _(spark, sf):
    return grouped.lines_per_order_histogram(table(spark, sf, "lineitem"), "l_orderkey")


@query(
    "repeated_key_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return grouped.repeated_key_rows(lines, ["l_orderkey", "l_linenumber"])


@query(
    "missing_amount_by_status",
    f"""{SALES_SQL} SELECT status, {ROWS}, count(*) - count(amount) AS missing_amount,
    round_even((count(*) - count(amount)) * 100.0 / count(order_id), 2) AS missing_amount_percent FROM sales GROUP BY status""",
)
def _(spark, sf):
    return grouped.missing_by_group(sales(spark, sf), "status", "amount")


@query(
    "zero_quantity_summary",
    f"""{SALES_SQL} SELECT count(CASE WHEN qty = 0 THEN 1 END) AS qty_zero_rows,
    count(CASE WHEN qty = 0 AND amount IS NULL THEN 1 END) AS qty_zero_and_amount_missing,
    coalesce(sum(CASE WHEN qty = 0 THEN amount END), 0.0) AS qty_zero_revenue_sum FROM sales""",
)
def _(spark, sf):
    return grouped.zero_quantity_summary(sales(spark, sf))


DAILY = f"strftime(date, '%Y-%m-%d') AS date, {REVENUE}, {ORDERS}, {CANCEL_RATE}"


@query("daily_summary", f"{SALES_SQL} SELECT {DAILY} FROM sales WHERE date IS NOT NULL GROUP BY sales.date")
def _(spark, sf):
    return grouped.daily_summary(sales(spark, sf)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "top_revenue_days",
    f"{SALES_SQL} SELECT {DAILY} FROM sales WHERE date IS NOT NULL GROUP BY sales.date ORDER BY revenue DESC, sales.date LIMIT 10",
)
def _(spark, sf):
    return grouped.top_revenue_days(sales(spark, sf)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "category_percent_summary",
    f"""{SALES_SQL} SELECT category, {REVENUE}, {QTY}, {ORDERS}, {CANCEL_RATE},
    round_even(coalesce(sum(revenue), 0) / (SELECT sum(revenue) FROM sales) * 100, 2) AS revenue_share,
    round_even(avg(cancelled) * 100, 2) AS cancel_rate_percent FROM sales GROUP BY category""",
)
def _(spark, sf):
    return grouped.category_percent_summary(sales(spark, sf, "part"))


@query(
    "status_summary",
    f"""{SALES_SQL} SELECT status, {ROWS}, {ORDERS}, {REVENUE}, {QTY},
    round_even(count(order_id) * 100.0 / (SELECT count(order_id) FROM sales), 2) AS row_percent FROM sales GROUP BY status""",
)
def _(spark, sf):
    return grouped.status_summary(sales(spark, sf))


@query(
    "largest_amounts",
    f"""{SALES_SQL} SELECT amount, order_id, line, status, qty FROM sales WHERE amount IS NOT NULL
    ORDER BY amount DESC, order_id, line, status, qty LIMIT 20""",
)
def _(spark, sf):
    return grouped.largest_rows(sales(spark, sf), "amount", 20, ["amount", "order_id", "line", "status", "qty"])


@query(
    "value_frequencies",
    f"""{SALES_SQL}, cells AS (
      SELECT 'status' AS "column", status AS value FROM sales UNION ALL
      SELECT 'courier_status', courier_status FROM sales UNION ALL
      SELECT 'sku', CAST(sku AS VARCHAR) FROM sales
    ), counted AS (SELECT "column", value, count(*) AS count FROM cells GROUP BY ALL)
    SELECT "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value NULLS LAST) AS position
    FROM counted QUALIFY position <= 20""",
)
def _(spark, sf):
    return grouped.value_frequencies(sales(spark, sf, "orders"), ["status", "courier_status", "sku"], 20)


@query(
    "sales_by_registered_tables",
    """SELECT n_name, sum(o_totalprice) AS spent, count(*) AS orders FROM orders
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def _(spark, sf):
    from colonnade.sources.tables import register_tables

    register_tables(spark, {f"file_{t}": f"{sf}/{t}.parquet" for t in ("orders", "customer", "nation")})
    return spark.sql(
        """SELECT n_name, sum(o_totalprice) AS spent, count(*) AS orders FROM file_orders
        JOIN file_customer ON c_custkey = o_custkey JOIN file_nation ON n_nationkey = c_nationkey GROUP BY n_name"""
    )


@query(
    "numeric_coercion",
    """SELECT source, sum(TRY_CAST(substr(source, 4) AS DOUBLE)) AS total, count(TRY_CAST(substr(source, 4) AS DOUBLE)) AS numbers,
    count(TRY_CAST(lang AS DOUBLE)) AS from_words FROM documents GROUP BY source""",
)
def _(spark, sf):
    cells = table(spark, sf, "documents").select("source", F.substring("source", 4, 100).alias("digits"), "lang")
    return cells.groupBy("source").agg(
        F.sum(number(cells, "digits")).alias("total"),
        F.count(number(cells, "digits")).alias("numbers"),
        F.count(number(cells, "lang")).alias("from_words"),
    )
