"""The source-to-table transformations, fed with the driver's tables under the sources' headers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue import query
from catalogue.views import table
from colonnade.operators import quality
from colonnade.plans import preparation
from colonnade.plans.scale import ensure_checkpoint_dir
from colonnade.sources import dictionary, profiles, tables


@query(
    "prepare_online_retail",
    "SELECT l_orderkey AS \"Invoice\", l_quantity AS \"Quantity\", l_extendedprice AS \"Price\", l_quantity * l_extendedprice AS \"Revenue\" FROM lineitem",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return preparation.online_retail(
        lines.select(F.col("l_orderkey").alias("Invoice"), F.col("l_quantity").cast("string").alias("Quantity"), F.col("l_extendedprice").alias("Price"))
    ).withColumn("Quantity", F.col("Quantity").cast("double"))


@query(
    "prepare_toy_store",
    """SELECT l_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_custkey AS user_id, l_partkey AS product_id, p_name AS product_name, p_name AS category,
    c_mktsegment AS segment, 'n' || c_nationkey AS utm_source, c_name AS utm_campaign, 1 AS quantity, l_extendedprice AS revenue, l_extendedprice * l_tax AS cost,
    l_extendedprice - l_extendedprice * l_tax AS profit FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey
    LEFT JOIN customer ON c_custkey = o_custkey""",
)
def _(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_extendedprice").alias("price_usd"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("cogs_usd"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.col("o_custkey").alias("website_session_id"),
        F.col("o_custkey").alias("user_id"),
    )
    products = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    sessions = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("website_session_id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("utm_source"),
        F.col("c_name").alias("utm_campaign"),
        F.col("c_mktsegment").alias("device_type"),
    )
    return preparation.toy_store(items, orders, products, sessions)


@query(
    "prepare_northwind",
    """SELECT l_orderkey AS "orderID", l_partkey AS "productID", l_quantity AS quantity, l_extendedprice / 10 AS "unitPrice", nullif(l_discount, 0) AS discount,
    o_custkey AS "customerID", strftime(o_orderdate, '%Y-%m-%d') AS "orderDate", p_name AS "productName", p_size AS "categoryID", 'size ' || p_size AS "categoryName",
    c_name AS city, c_mktsegment AS country, l_extendedprice / 10 * l_quantity * (1 - l_discount) AS sales
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN customer ON c_custkey = o_custkey""",
)
def _(spark, sf):
    details = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orderID"),
        F.col("l_partkey").alias("productID"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 10).alias("unitPrice"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("orderID"), F.col("o_custkey").alias("customerID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("orderDate")
    )
    parts = table(spark, sf, "part")
    products = parts.select(F.col("p_partkey").alias("productID"), F.col("p_name").alias("productName"), F.col("p_size").alias("categoryID"))
    categories = parts.select(F.col("p_size").alias("categoryID"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("categoryName")).distinct()
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("customerID"), F.col("c_name").alias("city"), F.col("c_mktsegment").alias("country"))
    return preparation.northwind(details, orders, products, categories, customers)


@query(
    "prepare_consumer_complaints",
    "SELECT o_orderstatus AS \"Product\", o_orderkey AS \"Complaint ID\", 1 AS \"Complaint Count\" FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("Product"), F.col("o_orderkey").alias("Complaint ID"))
    return preparation.consumer_complaints(orders)


@query(
    "prepare_unicorn_companies",
    "SELECT p_partkey, p_retailprice * 1e9 AS \"ValuationAmount\", CASE WHEN p_size > 10 THEN p_retailprice * 1e6 END AS \"FundingAmount\" FROM part",
)
def _(spark, sf):
    price = F.col("p_retailprice").cast("string")
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("$"), price, F.lit("B")).alias("Valuation"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("$"), price, F.lit("M"))).otherwise("Unknown").alias("Funding"),
    )
    return preparation.unicorn_companies(parts).drop("Valuation", "Funding")


@query(
    "prepare_employee_survey",
    """SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'Director' WHEN c_nationkey % 2 = 0 THEN 'Supervisor' ELSE 'Staff' END AS "Job Role" FROM customer""",
)
def _(spark, sf):
    survey = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") == 1, 1).otherwise(0).alias("Director"),
        F.lit(None).cast("string").alias("Manager"),
        (F.col("c_nationkey") % 2 == 0).alias("Supervisor"),
    )
    return preparation.employee_survey(survey).select("c_custkey", "Job Role")


@query(
    "prepare_remote_working_survey",
    """SELECT c_custkey AS "Response ID", '2021-01-01' AS "Date", c_mktsegment AS "Segment", c_nationkey AS "Region", c_acctbal AS "Target", 1 AS "Quantity" FROM customer""",
)
def _(spark, sf):
    survey = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Response ID"),
        F.col("c_mktsegment").alias("What industry do you work in?"),
        F.col("c_nationkey").alias("Metro / Regional area"),
        F.col("c_acctbal").alias("Going forward, what would you like?"),
    )
    return preparation.remote_working_survey(survey, 2021)


@query(
    "prepare_transit_ridership",
    """WITH w AS (SELECT o_orderdate AS d, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 1000 AS a, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS b FROM orders GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS "Date", 'Subways' AS "Transit Mode", CAST(a AS DOUBLE) AS "Ridership" FROM w UNION ALL
    SELECT strftime(d, '%Y-%m-%d'), 'Buses', CAST(b AS DOUBLE) FROM w""",
)
def _(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date")).agg(
        F.format_number(F.count_if(F.col("o_orderstatus") == "F") * 1000, 0).alias("Subways: Total Estimated Ridership"),
        F.count_if(F.col("o_orderstatus") == "O").alias("Buses: Total Estimated Ridership"),
        F.count(F.lit(1)).alias("Subways: % of Comparable Day"),
    )
    return preparation.transit_ridership(daily)


@query(
    "prepare_traffic_accidents",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS "Date", event_type AS "City", CAST(NULL AS VARCHAR) AS "Vehicle Type", 1 AS "Accident Count" FROM events""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("CRASH DATE"), F.col("event_type").alias("BOROUGH")
    )
    return preparation.traffic_accidents(events).drop("CRASH DATE", "BOROUGH")


@query(
    "prepare_fuel_economy",
    """SELECT p_partkey, CASE WHEN p_size <> 7 THEN CAST(p_size AS DOUBLE) END AS horsepower,
    upper(split_part(p_name, ' ', 1)[1:1]) || lower(split_part(p_name, ' ', 1)[2:]) AS "Manufacturer", (1900 + 70 + p_size % 12) || '-01-01' AS "Model Date" FROM part""",
)
def _(spark, sf):
    cars = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") == 7, "?").otherwise(F.col("p_size").cast("string")).alias("horsepower"),
        F.col("p_name").alias("car name"),
        (70 + F.col("p_size") % 12).alias("model year"),
    )
    return preparation.fuel_economy(cars).drop("car name", "model year")


# --- tables and dictionaries ----------------------------------------------------------


@query(
    "inferred_csv_types",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <> 3 THEN CAST(l_quantity AS DOUBLE) END AS gappy, l_extendedprice AS price, l_discount > 0.05 AS flag,
    CASE WHEN l_tax > 0.01 THEN l_returnflag END AS letter, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem""",
)
def _(spark, sf):
    from colonnade.sources.tables import infer_types

    lines = table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    return infer_types(
        lines.select(
            *[text(c).alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")],
            F.when(F.col("l_quantity") != 3, F.col("l_quantity").cast("int").cast("string")).otherwise("NA").alias("gappy"),
            text("l_extendedprice").alias("price"),
            F.when(F.col("l_discount") > 0.05, "True").otherwise("False").alias("flag"),
            F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).otherwise("").alias("letter"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        )
    )


@query("trimmed_snapshot", 'SELECT o_orderkey AS "Order ID", o_orderstatus AS "Status" FROM orders')
def _(spark, sf):
    from colonnade.sources.tables import snapshot

    orders = table(spark, sf, "orders")
    return snapshot(orders.select(F.col("o_orderkey").alias(" Order ID "), F.col("o_orderstatus").alias("Status  ")), rows=0)


@query(
    "dictionary_rows",
    """SELECT 'retail' AS domain, p_name AS column_name, 'row ' || p_partkey AS business_name, CAST(NULL AS VARCHAR) AS description, lower(p_type) AS semantic_role, 'number' AS data_type,
    CASE WHEN p_size > 25 THEN 'USD' END AS unit, CAST(NULL AS VARCHAR) AS aggregation, p_size % 3 = 0 AS sensitive,
    CASE p_partkey % 3 WHEN 0 THEN 'a;' || p_brand WHEN 1 THEN p_brand || ';b' ELSE '' END AS allowed FROM part WHERE p_partkey % 10 <> 0""",
)
def _(spark, sf):
    from colonnade.sources.dictionary import normalize_dictionary

    key = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        F.lit(" Retail ").alias("Domain"),
        F.when(key % 10 != 0, F.concat(F.lit(" "), "p_name")).otherwise("  ").alias("Field Name"),
        F.concat(F.lit("row "), key.cast("string")).alias("business"),
        F.col("p_type").alias("Semantic-Role"),
        F.lit("Number").alias("TYPE"),
        F.when(F.col("p_size") > 25, "USD").otherwise("").alias("unit"),
        F.when(F.col("p_size") % 3 == 0, "Yes").otherwise("n").alias("Is Sensitive"),
        F.when(key % 3 == 0, F.concat(F.lit(" a , "), "p_brand", F.lit(",")))
        .when(key % 3 == 1, F.concat("p_brand", F.lit(" | b||")))
        .alias("allowed"),
    )
    return normalize_dictionary(raw).withColumn("allowed_values", F.array_join("allowed_values", ";")).withColumnRenamed("allowed_values", "allowed")


# --- files ----------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def _(spark, sf):
    """Texts with line breaks and quotes, written as CSV and read block by block, typed by their content."""
    path = _folder(spark, "documents") + ".csv"
    tables.write(table(spark, sf, "documents"), path)
    return tables.read(spark, path, multi_line=True)


@query("csv_separated", "SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations")
def _(spark, sf):
    """The same with another separator and a stated schema."""
    path = _folder(spark, "conversations") + ".csv"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    turns.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return tables.read(spark, path, sep=";", multi_line=True, schema=", ".join(f"{n} {t}" for n, t in turns.dtypes))


@query("first_orders", 'SELECT o_orderkey AS "Order ID", o_orderstatus AS "Status" FROM orders LIMIT 700')
def _(spark, sf):
    """The first rows of a file, in its order, written as a snapshot and read again."""
    orders = table(spark, sf, "orders")
    path = _folder(spark, "orders") + ".parquet"
    tables.write_snapshot(orders.select(F.col("o_orderkey").alias(" Order ID "), F.col("o_orderstatus").alias("Status  ")), path, rows=700)
    return tables.read(spark, path)


LINE_DICTIONARY = [
    {"column_name": "l_returnflag", "data_type": "categorical", "allowed_values": ["A", "N"]},
    {"column_name": "l_linestatus", "data_type": "number", "allowed_values": ["O", "F"]},
    {"column_name": "l_shipdate", "data_type": "date"},
    {"column_name": "l_tax", "data_type": "number", "aggregation": "mean"},
    {"column_name": "l_tax", "aggregation": "average"},
    {"column_name": "l_missing", "semantic_role": "nonsense", "data_type": "money"},
]


@query(
    "dictionary_findings",
    """SELECT 'l_missing' AS column_name, 'absent' AS rule, CAST(NULL AS VARCHAR) AS value, 1 AS rows UNION ALL SELECT 'l_tax', 'repeated', NULL, 2
    UNION ALL SELECT 'l_tax', 'unknown_aggregation', 'average', 1 UNION ALL SELECT 'l_missing', 'unknown_semantic_role', 'nonsense', 1
    UNION ALL SELECT 'l_missing', 'unknown_data_type', 'money', 1 UNION ALL SELECT NULL, 'unknown_domain', 'shipping', 6
    UNION ALL SELECT 'l_returnflag', 'disallowed', min(l_returnflag), count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') HAVING count(*) > 0
    UNION ALL SELECT 'l_linestatus', 'wrong_type', min(l_linestatus), count(*) FROM lineitem WHERE TRY_CAST(l_linestatus AS DOUBLE) IS NULL AND l_linestatus IS NOT NULL HAVING count(*) > 0""",
)
def _(spark, sf):
    """A dictionary against the order lines: its own faults, and cells that break it."""
    return dictionary.dictionary_findings(dictionary.dictionary_fields(spark, "shipping", LINE_DICTIONARY), table(spark, sf, "lineitem"))


@query(
    "dictionary_round_trip",
    """SELECT 'retail' AS domain, p_name AS column_name, 'row ' || p_partkey AS business_name, CAST(NULL AS VARCHAR) AS description, lower(p_type) AS semantic_role, 'number' AS data_type,
    CASE WHEN p_size > 25 THEN 'USD' END AS unit, CAST(NULL AS VARCHAR) AS aggregation, p_size % 3 = 0 AS sensitive, CASE WHEN p_partkey % 3 = 0 THEN 'a;' || p_brand ELSE p_brand END AS allowed FROM part""",
)
def _(spark, sf):
    """Dictionary rows written in the ten-column form and read again."""
    key, path = F.col("p_partkey"), _folder(spark, "dictionary") + ".csv"
    fields = table(spark, sf, "part").select(
        F.lit("retail").alias("domain"), F.col("p_name").alias("column_name"), F.concat(F.lit("row "), key.cast("string")).alias("business_name"), F.lit(None).cast("string").alias("description"),
        F.lower("p_type").alias("semantic_role"), F.lit("number").alias("data_type"), F.when(F.col("p_size") > 25, "USD").alias("unit"), F.lit(None).cast("string").alias("aggregation"),
        (F.col("p_size") % 3 == 0).alias("sensitive"), F.when(key % 3 == 0, F.array(F.lit("a"), "p_brand")).otherwise(F.array("p_brand")).alias("allowed_values"),
    )
    dictionary.write_dictionary(fields, path)
    return dictionary.read_dictionary(spark, path).withColumn("allowed_values", F.array_join("allowed_values", ";")).withColumnRenamed("allowed_values", "allowed")


@query("written_profile", "SELECT 'l_quantity' AS \"column\", count(*) - count(l_quantity) AS missing FROM lineitem UNION ALL SELECT 'l_returnflag', count(*) - count(l_returnflag) FROM lineitem")
def _(spark, sf):
    """The JSON that a profile is written as, read again: missing cells by column."""
    path = _folder(spark, "profile")
    profiles.write_profile(quality.profile_dataframe(table(spark, sf, "lineitem").select("l_quantity", "l_returnflag")), path, "lineitem")
    return spark.read.json(f"{path}/missing").select("column", "missing")
