"""Cleaning, feature columns and text rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import query
from catalogue.views import table
from colonnade.functions import columns as C
from colonnade.operators import cleaning

TITLE = "list_aggregate(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda r: concat(upper(r[1:1]), lower(r[2:]))), 'string_agg', '')"


def raw_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a shop exports them: odd headers, padded texts, month-day-year dates."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left"
    )
    state = F.when(F.col("l_returnflag") == "R", " Cancelled ").when(F.col("l_returnflag") == "A", "Shipped - Delivered to Buyer")
    return lines.select(
        F.col("l_linenumber").alias("index"),
        F.col("l_orderkey").alias("Order ID"),
        F.when(F.col("l_linenumber") == 3, "soon").otherwise(F.date_format("l_shipdate", "MM-dd-yy")).alias("Date"),
        state.alias("Status"),
        F.concat(F.lit("  shop-"), F.col("l_linestatus"), F.lit(" ")).alias("Sales Channel "),
        F.concat(F.lit(" north "), F.lower("l_linestatus")).alias("ship-city"),
        F.concat("p_name", F.lit("-3a")).alias("Category"),
        F.when(F.col("l_quantity") == 1, 0.0).otherwise(F.col("l_quantity")).alias("Qty"),
        F.when(F.col("l_quantity") == 2, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("Amount"),
        F.when(F.col("l_discount") > 0.05, "promo").alias("promotion-ids"),
        F.lit("x").alias("Unnamed: 22"),
    )


@query(
    "prepare_sales",
    f"""WITH raw AS (
      SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS d,
        CASE WHEN l_returnflag = 'R' THEN 'Cancelled' WHEN l_returnflag = 'A' THEN 'Shipped - Delivered to Buyer' END AS status,
        l_linestatus, p_name || '-3a' AS cat, CASE WHEN l_quantity = 1 THEN 0.0 ELSE l_quantity END AS q,
        CASE WHEN l_quantity <> 2 THEN l_extendedprice END AS amount, l_discount FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey AS order_id, strftime(d, '%Y-%m-%d') AS date, year(d) AS order_year, strftime(d, '%Y-%m') AS order_month, day(d) AS order_day,
      dayname(d) AS order_day_name, status, lower(status) AS status_clean, coalesce(status LIKE 'Cancelled%', false) AS is_cancelled,
      coalesce(status LIKE 'Shipped%', false) AS is_shipped, coalesce(status LIKE '%Delivered%', false) AS is_delivered,
      'shop-' || l_linestatus AS sales_channel, 'NORTH ' || upper(l_linestatus) AS ship_city, {TITLE.format(x='cat')} AS category, q AS qty,
      l_discount > 0.05 AS has_promotion, amount AS revenue, CASE WHEN q > 0 THEN amount / q END AS amount_per_item FROM raw""",
)
def _(spark, sf):
    prepared = cleaning.prepare_sales(raw_order_lines(spark, sf))
    return prepared.withColumn("date", F.date_format("date", "yyyy-MM-dd")).drop("amount", "promotion_ids")


@query(
    "clean_column_names",
    "SELECT l_linenumber AS ship_service_level, l_tax AS unnamed_22x, l_quantity AS order_id FROM lineitem",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    ugly = lines.select(
        F.col("l_linenumber").alias(" Ship-Service  Level "), F.col("l_tax").alias("Unnamed: 22x"), F.col("l_quantity").alias("Order_ID_")
    )
    return cleaning.clean_column_names(ugly)


@query(
    "money_text",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice * 1e9 WHEN 1 THEN p_retailprice * 1e6 WHEN 2 THEN p_retailprice * 1e3
    WHEN 3 THEN p_retailprice END AS amount FROM part""",
)
def _(spark, sf):
    price = F.col("p_retailprice").cast("string")
    kind = F.col("p_partkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("$"), price, F.lit("B")))
        .when(kind == 1, F.concat(F.lit("$ "), price, F.lit("m")))
        .when(kind == 2, F.concat(price, F.lit(" K")))
        .when(kind == 3, F.concat(F.lit("$"), price))
        .otherwise(F.concat(price, F.lit(" USD")))
    )
    parts = table(spark, sf, "part").select("p_partkey", text.alias("text"))
    return parts.select("p_partkey", C.money(F.col("text")).alias("amount"))


def _positive_sql(words: list[str]) -> str:
    quoted = ", ".join(f"'{w}'" for w in words)
    return f"coalesce(lower(trim(word)) IN ({quoted}), false)"


@query(
    "positive_values",
    f"""WITH x AS (SELECT doc_id, quality, CASE doc_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN '1.0' WHEN 2 THEN 'responded' WHEN 3 THEN 'no' WHEN 4 THEN 'CONVERTED ' END AS word FROM labels)
    SELECT doc_id, quality = 1 AS from_number, quality * 2 <> 0 AS from_nonzero, {_positive_sql(C.POSITIVE_TEXT['summary'])} AS by_summary,
    {_positive_sql(C.POSITIVE_TEXT['segment'])} AS by_segment, {_positive_sql(C.POSITIVE_TEXT['insight'])} AS by_insight FROM x""",
)
def _(spark, sf):
    kind = F.col("doc_id") % 6
    word = F.when(kind == 0, " Yes").when(kind == 1, "1.0").when(kind == 2, "responded").when(kind == 3, "no").when(kind == 4, "CONVERTED ")
    x = table(spark, sf, "labels").select("doc_id", "quality", (F.col("quality") * 2).alias("twice"), word.alias("word"))
    return x.select(
        "doc_id",
        C.is_positive(x, "quality").alias("from_number"),
        C.is_positive(x, "twice", "insight").alias("from_nonzero"),
        *[C.is_positive(x, "word", rule).alias(f"by_{rule}") for rule in ("summary", "segment", "insight")],
    )


@query(
    "text_rules",
    f"""SELECT page_id, split_part(url, ':', 1) AS scheme, {TITLE.format(x="split_part(replace(url, '/', ' '), ' ', 1)")} AS first_word,
    (1900 + page_id % 100) || '-01-01' AS year_text FROM pages""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id",
        C.before_colon(F.col("url")).alias("scheme"),
        C.first_word_title(F.regexp_replace("url", "/", " ")).alias("first_word"),
        C.year_to_date_text((F.col("page_id") % 100).cast("string")).alias("year_text"),
    )


@query(
    "first_truthy_column",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'Director' WHEN c_nationkey <> 0 THEN 'Manager' WHEN c_mktsegment LIKE 'B%' THEN 'Supervisor' ELSE 'Staff' END AS job_role FROM customer""",
)
def _(spark, sf):
    levels = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 5000, "Yes").otherwise(" no ").alias("Director"),
        F.col("c_nationkey").alias("Manager"),
        F.when(F.col("c_mktsegment").startswith("B"), F.col("c_mktsegment")).alias("Supervisor"),
    )
    names = ["Director", "Manager", "Supervisor"]
    return levels.select("c_custkey", C.first_truthy_name(levels, names, "Staff").alias("job_role"))


@query(
    "date_reading",
    """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate END, '%Y-%m-%d') AS day,
    concat(CAST(year(o_orderdate) AS VARCHAR), 'Q', CAST(quarter(o_orderdate) AS VARCHAR)) AS quarter,
    strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' || strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week FROM orders""",
)
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 1, F.date_format("o_orderdate", "M/d/yyyy"))
        .when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("later")
    )
    x = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", text.alias("text"))
    stamp = F.col("o_orderdate")
    return x.select(
        "o_orderkey",
        F.date_format(C.timestamp(x, "text"), "yyyy-MM-dd").alias("day"),
        C.period_label(C.period_start(stamp, "Q"), "Q").alias("quarter"),
        C.period_label(C.period_start(stamp, "W"), "W").alias("week"),
    )
