"""The driver's tables as the business tables the operators expect.

Only the joins a query asks for are made.  No join carries a hint: Spark broadcasts
a side it knows to be small and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.roles import SemanticProfile, profile_of


# Columns of the tables, so that opening one needs no look into its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def sales(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    """Order lines: amounts are missing and quantity is zero where the raw quantity is one."""
    lines = table(spark, sf, "lineitem")
    amount = F.when(F.col("l_quantity") > 1, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    df = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_quantity") == 1, 0.0).otherwise(F.col("l_quantity")).alias("qty"),
        amount.alias("amount"),
        amount.alias("revenue"),
        (F.col("l_returnflag") == "R").alias("is_cancelled"),
        F.col("l_linestatus").alias("fulfilment"),
        F.concat("l_returnflag", "l_linestatus").alias("status"),
        (F.col("l_discount") > 0).alias("has_promotion"),
        F.col("l_shipdate").alias("date"),
        F.date_format("l_shipdate", "yyyy-MM").alias("order_month"),
        F.col("l_discount").alias("discount"),
    )
    if "part" in parts:
        items = table(spark, sf, "part").select(
            F.col("p_partkey").alias("sku"), F.col("p_type").alias("category"), F.col("p_size").alias("size")
        )
        df = df.join(items, "sku", "left")
    if "orders" in parts or "customer" in parts:
        orders = table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.nullif("o_orderpriority", F.lit("5-LOW")).alias("courier_status"),
            F.col("o_custkey").alias("customer_id"),
        )
        df = df.join(orders, "order_id", "left")
    if "customer" in parts:
        nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("__nation"), F.col("n_name").alias("ship_state"))
        buyers = table(spark, sf, "customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("ship_city"),
            F.col("c_nationkey").alias("__nation"),
            F.col("c_mktsegment").alias("segment"),
            (F.col("c_mktsegment") == "BUILDING").alias("b2b"),
        )
        df = df.join(buyers.join(nation, "__nation", "left").drop("__nation"), "customer_id", "left")
    return df


SALES_SQL = """
WITH sales AS (
  SELECT l_orderkey AS order_id, l_partkey AS sku, l_linenumber AS line,
         CASE WHEN l_quantity = 1 THEN 0.0 ELSE l_quantity END AS qty,
         CASE WHEN l_quantity > 1 THEN l_extendedprice * (1 - l_discount) END AS amount,
         CASE WHEN l_quantity > 1 THEN l_extendedprice * (1 - l_discount) END AS revenue,
         l_returnflag = 'R' AS is_cancelled,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS cancelled,
         l_linestatus AS fulfilment, l_returnflag || l_linestatus AS status,
         l_discount > 0 AS has_promotion, l_shipdate AS date,
         strftime(l_shipdate, '%Y-%m') AS order_month, l_discount AS discount,
         p_type AS category, p_size AS size,
         nullif(o_orderpriority, '5-LOW') AS courier_status, o_custkey AS customer_id,
         c_name AS ship_city, n_name AS ship_state, c_mktsegment AS segment,
         c_mktsegment = 'BUILDING' AS b2b
  FROM lineitem
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
)
"""

#: order lines joined to their part, with a profit: what retail operators read
RETAIL_PROFILE: SemanticProfile = profile_of(
    "retail", revenue="sales", profit="profit", quantity="qty", discount="discount", date="date",
    category="category", segment="segment", state="state",
)


def retail(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    items = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_retailprice", F.col("p_type").alias("category"), F.col("p_brand").alias("brand")
    )
    df = lines.join(items, "l_partkey", "left")
    if "customer" in parts:
        nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("__nation"), F.col("n_name").alias("state"))
        buyers = table(spark, sf, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("__nation")
        )
        orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        # orders meet their buyers first, so that lines are shuffled by order only
        bought = orders.join(buyers.join(nation, "__nation", "left").drop("__nation"), "o_custkey", "left")
        df = df.join(bought, "l_orderkey", "left")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    kept = ["category", "brand", *(["segment", "state"] if "customer" in parts else [])]
    return df.select(
        *kept,
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
        revenue.alias("sales"),
        (revenue - F.col("p_retailprice") * F.col("l_quantity") * 2.0886).alias("profit"),
    )


RETAIL_SQL = """
WITH retail AS (
  SELECT p_type AS category, p_brand AS brand, c_mktsegment AS segment, n_name AS state,
         l_shipdate AS date, l_quantity AS qty,
         CASE WHEN l_discount > 0 THEN l_discount END AS discount,
         l_extendedprice * (1 - l_discount) AS sales,
         l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 2.0886 AS profit
  FROM lineitem
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
)
"""

#: labelled documents: outcomes by language and source; text without a label has no outcome
OUTCOME_PROFILE: SemanticProfile = profile_of(
    "marketing", target="quality_label", conversion="toxic", country="lang", campaign="source", department="lang",
    job_role="source", overtime="short",
)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.when(F.col("quality") == 1, " Yes ").when(F.col("quality") == 0, "no").alias("quality_label"),
        "toxic",
        F.when(F.col("n_chars") < 1000, "yes").otherwise("no").alias("short"),
    )


OUTCOMES_SQL = """
WITH outcomes AS (
  SELECT d.doc_id, lang, source, n_chars, CASE WHEN quality = 1 THEN ' Yes ' WHEN quality = 0 THEN 'no' END AS quality_label,
         CASE WHEN quality = 1 THEN 1 ELSE 0 END AS hit, toxic, CASE WHEN n_chars < 1000 THEN 'yes' ELSE 'no' END AS short
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)
"""

#: one row per customer with orders behind it: income, tenure, spend by priority, counts by channel
PEOPLE_PROFILE: SemanticProfile = profile_of(
    "hr", salary="income", tenure="tenure", target="left", department="department", job_role="segment",
    overtime="overtime", recency="recency",
)


def people(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    end = F.lit("2001-08-01").cast("date")
    history = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.datediff(end, F.min("o_orderdate").cast("date")).alias("__since_first"),
        F.datediff(end, F.max("o_orderdate").cast("date")).alias("recency"),
        *[
            F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(f"Mnt{name}")
            for s, name in (("F", "Wines"), ("O", "Meat"), ("P", "Gold"))
        ],
        *[
            F.count_if(F.col("o_orderpriority") == p).alias(f"Num{name}Purchases")
            for p, name in (("1-URGENT", "Web"), ("2-HIGH", "Catalog"), ("3-MEDIUM", "Store"), ("5-LOW", "Deals"))
        ],
    )
    customers = table(spark, sf, "customer")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("department"))
    return customers.join(history, "c_custkey", "left").join(nation, "c_nationkey", "left").select(
        F.col("c_custkey").alias("ID"),
        F.when(F.col("c_acctbal") > 0, F.round("c_acctbal", -2)).alias("income"),
        (F.col("__since_first") - 2200).cast("double").alias("tenure"),
        F.col("recency").alias("recency"),
        F.when(F.col("recency") > 200, "Yes").when(F.col("recency") <= 200, "No").alias("left"),
        "department",
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 3 == 0, "Yes").otherwise("No").alias("overtime"),
        "MntWines",
        "MntMeat",
        "MntGold",
        "NumWebPurchases",
        "NumCatalogPurchases",
        "NumStorePurchases",
        "NumDealsPurchases",
        (F.col("NumWebPurchases") > 2).alias("AcceptedCmp1"),
        F.col("NumCatalogPurchases").alias("AcceptedCmp2"),
        F.when(F.col("recency") > 100, "accepted").otherwise("not accepted").alias("AcceptedCmp3"),
    )


PEOPLE_SQL = """
WITH history AS (
  SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2001-08-01') AS since_first,
         date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01') AS recency,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS wines,
         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS meat,
         sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS gold,
         count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS web,
         count(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS catalog,
         count(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 END) AS store,
         count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS deals
  FROM orders GROUP BY o_custkey
), people AS (
  SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, -2) END AS income,
         CAST(since_first - 2200 AS DOUBLE) AS tenure, recency,
         CASE WHEN recency > 200 THEN 'Yes' WHEN recency <= 200 THEN 'No' END AS "left",
         CASE WHEN recency > 200 THEN 1 ELSE 0 END AS hit,
         n_name AS department, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS overtime,
         coalesce(wines, 0) + coalesce(meat, 0) + coalesce(gold, 0) AS monetary,
         coalesce(web, 0) + coalesce(catalog, 0) + coalesce(store, 0) + coalesce(deals, 0) AS frequency,
         web, catalog, store, deals
  FROM customer LEFT JOIN history ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
)
"""
