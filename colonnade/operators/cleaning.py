"""Cleaning and feature columns for order-line tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col, is_temporal, is_text, number, read_date, strip, timestamp, title_case, value

# Columns dropped, trimmed and upper-cased.
NOISE_COLUMNS = ["index", "unnamed_22"]
TEXT_COLUMNS = [
    "status", "fulfilment", "sales_channel", "ship_service_level", "category", "size",
    "courier_status", "currency", "ship_country", "ship_city", "ship_state", "fulfilled_by",
]
LOCATION_COLUMNS = ["ship_city", "ship_state", "ship_country"]


def clean_column_name(name: str) -> str:
    lowered = re.sub(r"[- ]", "_", name.strip().lower()).replace(":", "")
    return re.sub(r"_{2,}", "_", lowered).strip("_")


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_column_name(c) for c in df.columns])


def clean_sales(df: DataFrame) -> DataFrame:
    """Tidy names, drop noise columns, parse month-day-year dates, normalize texts."""
    named = clean_column_names(df)
    changed: dict[str, Column] = {}
    for name in named.columns:
        if name in TEXT_COLUMNS:
            text = strip(col(name).cast("string"))
            if name in LOCATION_COLUMNS:
                text = F.upper(text)
            changed[name] = title_case(text) if name == "category" else text
    if "date" in named.columns and is_text(named, "date"):
        changed["date"] = read_date(col("date"), "MM-dd-yy")
    return named.drop(*NOISE_COLUMNS).withColumns(changed)


def add_sales_features(df: DataFrame) -> DataFrame:
    """Calendar columns, status and promotion flags, revenue and amount per item.

    Every input column is optional; what depends on an absent one is false or null.
    """
    features: dict[str, Column] = {}
    if "date" in df.columns:
        stamp = col("date") if is_temporal(df, "date") else timestamp(df, "date")
        features |= {
            "date": stamp,
            "order_year": F.year(stamp),
            "order_month": F.date_format(stamp, "yyyy-MM"),
            "order_day": F.dayofmonth(stamp),
            "order_day_name": F.date_format(stamp, "EEEE"),
        }
    status = F.lower(col("status").cast("string")) if "status" in df.columns else F.lit("")
    features["status_clean"] = status
    for flag in ("cancelled", "shipped", "delivered"):
        features[f"is_{flag}"] = F.coalesce(F.contains(status, F.lit(flag)), F.lit(False))
    features["has_promotion"] = value(df, "promotion_ids").isNotNull() if "promotion_ids" in df.columns else F.lit(False)
    nothing = F.lit(None).cast("double")
    amount = number(df, "amount").cast("double") if "amount" in df.columns else nothing
    qty = number(df, "qty").cast("double") if "qty" in df.columns else nothing
    features["revenue"] = amount
    features["amount_per_item"] = F.when(qty > 0, amount / qty)
    return df.withColumns(features)


def prepare_sales(df: DataFrame) -> DataFrame:
    return df.transform(clean_sales).transform(add_sales_features)


def find_column(df: DataFrame, *needles: str) -> str:
    """First column whose name contains one of the needles, ignoring case."""
    for needle in needles:
        for name in df.columns:
            if needle.lower() in name.lower():
                return name
    raise ValueError(f"Cannot find column containing any of: {list(needles)}")
