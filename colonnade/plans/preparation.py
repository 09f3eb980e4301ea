"""Source tables to analysis tables: one transformation per known source.

Each function takes the raw tables and returns a lazy DataFrame.  Joins carry no
hints: Spark broadcasts a side whose size it knows to be small, and splits skewed
keys at run time otherwise.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.columns import (
    before_colon,
    col,
    decimal_number,
    first_truthy_name,
    first_word_title,
    is_numeric,
    money,
    number,
    strip,
    timestamp,
    year_to_date_text,
)
from colonnade.operators.cleaning import find_column
from colonnade.sources.dictionary import dictionary_fields
from colonnade.sources.tables import snapshot


def online_retail(df: DataFrame) -> DataFrame:
    """Adds revenue when quantity and price are there."""
    if {"Quantity", "Price"} <= set(df.columns):
        return df.withColumn("Revenue", number(df, "Quantity") * number(df, "Price"))
    return df


def toy_store(items: DataFrame, orders: DataFrame, products: DataFrame, sessions: DataFrame) -> DataFrame:
    """Order items with their order, product and session, as one flat table."""
    wide = (
        items.drop("created_at", "user_id", "website_session_id", "items_purchased")
        .join(orders.select("order_id", F.col("created_at").alias("order_date"), "website_session_id", "user_id"), "order_id", "left")
        .join(products.select("product_id", "product_name"), "product_id", "left")
        .join(sessions.select("website_session_id", "utm_source", "utm_campaign", "device_type"), "website_session_id", "left")
    )
    revenue, cost = number(wide, "price_usd"), number(wide, "cogs_usd")
    return wide.select(
        "order_id",
        "order_date",
        "user_id",
        "product_id",
        "product_name",
        F.col("product_name").alias("category"),
        F.col("device_type").alias("segment"),
        "utm_source",
        "utm_campaign",
        F.lit(1).alias("quantity"),
        revenue.alias("revenue"),
        cost.alias("cost"),
        (revenue - cost).alias("profit"),
    )


def northwind(
    details: DataFrame, orders: DataFrame, products: DataFrame, categories: DataFrame, customers: DataFrame
) -> DataFrame:
    """Order details with order, product, category and customer, plus net sales."""
    wide = (
        details.join(orders, "orderID", "left")
        .join(products.select("productID", "productName", "categoryID"), "productID", "left")
        .join(categories.select("categoryID", "categoryName"), "categoryID", "left")
        .join(customers.select("customerID", "city", "country"), "customerID", "left")
    )
    return wide.withColumn("sales", net_sales(wide, "unitPrice", "quantity", "discount"))


def net_sales(df: DataFrame, price: str, quantity: str, discount: str):
    """price * quantity * (1 - discount), a missing discount counting as none."""
    return number(df, price) * number(df, quantity) * (1 - F.coalesce(number(df, discount).cast("double"), F.lit(0.0)))


def consumer_complaints(df: DataFrame) -> DataFrame:
    return df.withColumn("Complaint Count", F.lit(1))


def stock_prices(df: DataFrame) -> DataFrame:
    return as_declared(df, "stock_prices")


def unicorn_companies(df: DataFrame) -> DataFrame:
    """Money texts as numbers; funding is optional."""
    funding = money(col("Funding").cast("string")) if "Funding" in df.columns else F.lit(None).cast("double")
    return df.withColumns({"ValuationAmount": money(col("Valuation").cast("string")), "FundingAmount": funding})


def bank_marketing(df: DataFrame) -> DataFrame:
    return as_declared(df, "bank_marketing")


def employee_survey(df: DataFrame) -> DataFrame:
    """One job-role column from the yes/no columns of the four levels."""
    levels = [c for c in ("Director", "Manager", "Supervisor", "Staff") if c in df.columns]
    return df.withColumn("Job Role", first_truthy_name(df, levels, "Staff")) if levels else df


def remote_working_survey(df: DataFrame, year: int) -> DataFrame:
    """Six tidy columns found by parts of the survey's long headers."""
    pick = lambda *needles: col(find_column(df, *needles))
    return df.select(
        pick("Response ID").alias("Response ID"),
        F.lit(f"{year}-01-01").alias("Date"),
        pick("industry").alias("Segment"),
        pick("Metro", "Regional").alias("Region"),
        pick("recommend remote", "Going forward", "prefer").alias("Target"),
        F.lit(1).alias("Quantity"),
    )


def airline_satisfaction(df: DataFrame) -> DataFrame:
    return as_declared(df, "airline_satisfaction")


def candy_orders(df: DataFrame) -> DataFrame:
    return as_declared(df, "candy_orders")


def transit_ridership(wide: DataFrame) -> DataFrame:
    """One row per date and mode from the wide table's ``Total`` columns."""
    totals = [c for c in wide.columns if "Total" in c]
    texts = wide.select(col("Date"), *[col(c).cast("string").alias(c) for c in totals])
    long = texts.unpivot([col("Date")], [col(c) for c in totals], "Transit Mode", "Ridership")
    return long.select(
        "Date",
        before_colon(col("Transit Mode")).alias("Transit Mode"),
        decimal_number(F.trim(F.regexp_replace("Ridership", ",", ""))).alias("Ridership"),
    )


def traffic_accidents(df: DataFrame) -> DataFrame:
    vehicle = col("VEHICLE TYPE CODE 1") if "VEHICLE TYPE CODE 1" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {"Date": col("CRASH DATE"), "City": col("BOROUGH"), "Vehicle Type": vehicle, "Accident Count": F.lit(1)}
    )


def student_performance(df: DataFrame) -> DataFrame:
    return as_declared(df, "student_performance")


def fuel_economy(df: DataFrame) -> DataFrame:
    """Horsepower without placeholders, manufacturer from the car's name, model year as a date text."""
    power = col("horsepower") if is_numeric(df, "horsepower") else F.nullif(col("horsepower"), F.lit("?"))
    return df.withColumns(
        {
            "horsepower": power.cast("double") if is_numeric(df, "horsepower") else decimal_number(F.trim(power)),
            "Manufacturer": first_word_title(col("car name").cast("string")),
            "Model Date": year_to_date_text(col("model year").cast("string")),
        }
    )


# Source, domain, column, display name, role, type, aggregation, unit, sensitive; one row a field.
FIELDS = [
    ("online_retail", "ecommerce", "Invoice", "Invoice", "customer", "string", "", "", True),
    ("online_retail", "ecommerce", "Description", "Description", "category", "string", "", "", False),
    ("online_retail", "ecommerce", "Quantity", "Quantity", "quantity", "number", "sum", "", False),
    ("online_retail", "ecommerce", "InvoiceDate", "InvoiceDate", "date", "date", "", "", False),
    ("online_retail", "ecommerce", "Revenue", "Revenue", "revenue", "number", "sum", "GBP", False),
    ("online_retail", "ecommerce", "Country", "Country", "country", "string", "", "", False),
    ("toy_store", "ecommerce", "order_id", "order_id", "customer", "string", "", "", True),
    ("toy_store", "ecommerce", "order_date", "order_date", "date", "date", "", "", False),
    ("toy_store", "ecommerce", "category", "category", "category", "string", "", "", False),
    ("toy_store", "ecommerce", "segment", "segment", "segment", "string", "", "", False),
    ("toy_store", "ecommerce", "utm_campaign", "utm_campaign", "campaign", "string", "", "", False),
    ("toy_store", "ecommerce", "utm_source", "utm_source", "channel", "string", "", "", False),
    ("toy_store", "ecommerce", "quantity", "quantity", "quantity", "number", "sum", "", False),
    ("toy_store", "ecommerce", "revenue", "revenue", "revenue", "number", "sum", "USD", False),
    ("toy_store", "ecommerce", "cost", "cost", "cost", "number", "sum", "USD", False),
    ("toy_store", "ecommerce", "profit", "profit", "profit", "number", "sum", "USD", False),
    ("northwind", "retail", "orderDate", "orderDate", "date", "date", "", "", False),
    ("northwind", "retail", "sales", "sales", "revenue", "number", "sum", "USD", False),
    ("northwind", "retail", "quantity", "quantity", "quantity", "number", "sum", "", False),
    ("northwind", "retail", "discount", "discount", "discount", "number", "mean", "", False),
    ("northwind", "retail", "categoryName", "categoryName", "category", "string", "", "", False),
    ("northwind", "retail", "country", "country", "country", "string", "", "", False),
    ("northwind", "retail", "city", "city", "city", "string", "", "", False),
    ("northwind", "retail", "customerID", "customerID", "customer", "string", "", "", True),
    ("consumer_complaints", "finance", "Date received", "Date received", "date", "date", "", "", False),
    ("consumer_complaints", "finance", "Product", "Product", "category", "string", "", "", False),
    ("consumer_complaints", "finance", "State", "State", "state", "string", "", "", False),
    ("consumer_complaints", "finance", "Complaint Count", "Complaint Count", "quantity", "number", "sum", "", False),
    ("stock_prices", "finance", "date", "date", "date", "date", "", "", False),
    ("stock_prices", "finance", "symbol", "symbol", "category", "string", "", "", False),
    ("stock_prices", "finance", "close", "Close Price", "revenue", "number", "mean", "USD", False),
    ("stock_prices", "finance", "volume", "volume", "quantity", "number", "sum", "", False),
    ("unicorn_companies", "finance", "Date Joined", "Date Joined", "date", "date", "", "", False),
    ("unicorn_companies", "finance", "Industry", "Industry", "category", "string", "", "", False),
    ("unicorn_companies", "finance", "Country", "Country", "country", "string", "", "", False),
    ("unicorn_companies", "finance", "ValuationAmount", "Valuation", "revenue", "number", "sum", "USD", False),
    ("unicorn_companies", "finance", "FundingAmount", "Funding", "cost", "number", "sum", "USD", False),
    ("bank_marketing", "marketing", "age", "age", "customer", "number", "mean", "", True),
    ("bank_marketing", "marketing", "job", "job", "segment", "string", "", "", False),
    ("bank_marketing", "marketing", "education", "education", "segment", "string", "", "", False),
    ("bank_marketing", "marketing", "balance", "balance", "monetary", "number", "mean", "", False),
    ("bank_marketing", "marketing", "contact", "contact", "channel", "string", "", "", False),
    ("bank_marketing", "marketing", "month", "month", "date", "string", "", "", False),
    ("bank_marketing", "marketing", "campaign", "campaign", "campaign", "number", "sum", "", False),
    ("bank_marketing", "marketing", "pdays", "pdays", "recency", "number", "mean", "", False),
    ("bank_marketing", "marketing", "y", "y", "target", "string", "", "", False),
    ("employee_survey", "survey", "Department", "Department", "department", "string", "", "", False),
    ("employee_survey", "survey", "Job Role", "Job Role", "job_role", "string", "", "", False),
    ("employee_survey", "survey", "Response", "Response", "target", "number", "mean", "", False),
    ("remote_working_survey", "survey", "Date", "Date", "date", "date", "", "", False),
    ("remote_working_survey", "survey", "Segment", "Segment", "segment", "string", "", "", False),
    ("remote_working_survey", "survey", "Region", "Region", "country", "string", "", "", False),
    ("remote_working_survey", "survey", "Target", "Target", "target", "string", "", "", False),
    ("remote_working_survey", "survey", "Quantity", "Quantity", "quantity", "number", "sum", "", False),
    ("airline_satisfaction", "survey", "Satisfaction", "Satisfaction", "target", "string", "", "", False),
    ("airline_satisfaction", "survey", "Customer Type", "Customer Type", "segment", "string", "", "", False),
    ("airline_satisfaction", "survey", "Class", "Class", "category", "string", "", "", False),
    ("airline_satisfaction", "survey", "Flight Distance", "Flight Distance", "quantity", "number", "mean", "", False),
    ("candy_orders", "logistics", "Order Date", "Order Date", "date", "date", "", "", False),
    ("candy_orders", "logistics", "Sales", "Sales", "revenue", "number", "sum", "USD", False),
    ("candy_orders", "logistics", "Cost", "Cost", "cost", "number", "sum", "USD", False),
    ("candy_orders", "logistics", "Gross Profit", "Gross Profit", "profit", "number", "sum", "USD", False),
    ("candy_orders", "logistics", "Units", "Units", "quantity", "number", "sum", "", False),
    ("candy_orders", "logistics", "Division", "Division", "category", "string", "", "", False),
    ("candy_orders", "logistics", "State/Province", "State/Province", "state", "string", "", "", False),
    ("candy_orders", "logistics", "City", "City", "city", "string", "", "", False),
    ("transit_ridership", "logistics", "Date", "Date", "date", "date", "", "", False),
    ("transit_ridership", "logistics", "Transit Mode", "Transit Mode", "category", "string", "", "", False),
    ("transit_ridership", "logistics", "Ridership", "Ridership", "quantity", "number", "sum", "", False),
    ("traffic_accidents", "logistics", "Date", "Date", "date", "date", "", "", False),
    ("traffic_accidents", "logistics", "City", "City", "city", "string", "", "", False),
    ("traffic_accidents", "logistics", "Vehicle Type", "Vehicle Type", "category", "string", "", "", False),
    ("traffic_accidents", "logistics", "Accident Count", "Accident Count", "quantity", "number", "sum", "", False),
    ("student_performance", "education", "school", "school", "department", "string", "", "", False),
    ("student_performance", "education", "sex", "sex", "segment", "string", "", "", True),
    ("student_performance", "education", "age", "age", "customer", "number", "mean", "", True),
    ("student_performance", "education", "studytime", "studytime", "frequency", "number", "mean", "", False),
    ("student_performance", "education", "absences", "absences", "quantity", "number", "sum", "", False),
    ("student_performance", "education", "G3", "G3", "target", "number", "mean", "", False),
    ("fuel_economy", "product", "Model Date", "Model Date", "date", "date", "", "", False),
    ("fuel_economy", "product", "Manufacturer", "Manufacturer", "category", "string", "", "", False),
    ("fuel_economy", "product", "mpg", "mpg", "quantity", "number", "mean", "", False),
]


def fields_of(source: str) -> list[dict[str, Any]]:
    names = ("source", "domain", "column_name", "business_name", "semantic_role", "data_type", "aggregation", "unit", "sensitive")
    found = [dict(zip(names, row)) for row in FIELDS if row[0] == source]
    if not found:
        raise ValueError(f"Unknown source: {source}")
    return found


def as_declared(df: DataFrame, source: str) -> DataFrame:
    """The table with trimmed column names, and the columns of the source's dictionary as the types it declares.

    A text that is no number or date of a number or date column becomes null.
    """
    df = snapshot(df)
    read = {"number": lambda c: number(df, c).cast("double"), "date": lambda c: timestamp(df, c), "string": lambda c: strip(col(c).cast("string"))}
    typed = {f["column_name"]: read[f["data_type"]](f["column_name"]) for f in fields_of(source) if f["column_name"] in df.columns}
    return df.select(*[typed[c].alias(c) if c in typed else col(c) for c in df.columns])


def source_dictionary(spark: SparkSession, source: str) -> DataFrame:
    """The data dictionary that belongs to a prepared source."""
    fields = fields_of(source)
    rows = [{k: v or None if k in ("aggregation", "unit") else v for k, v in f.items() if k not in ("source", "domain")} for f in fields]
    return dictionary_fields(spark, fields[0]["domain"], rows)
