"""Grouped measures over business tables: sums, distinct orders, rates and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col, is_temporal, number, percent, summand, timestamp, total, value
from colonnade.functions.validate import require_columns, require_limit, require_metric
from colonnade.plans.measures import grouped_measure, scalar_of

PROMOTION_NOTE = "Promotion comparison is associative, not causal. Missing promotion_ids may overlap with cancellation behavior."
B2B_NOTE = "B2B sample is small compared with non-B2B, so interpret differences cautiously."
REVENUE_NOTES = (
    "Revenue is calculated from available amount values.",
    "Rows with missing amount are excluded from revenue sums.",
)


def groupby_aggregate(df: DataFrame, group_by: str, metric: str, aggregation: str, limit: int | None = 50) -> DataFrame:
    """Top groups by one aggregated metric; the null group counts as a group."""
    require_columns(df, [group_by, metric])
    require_metric(df, metric, aggregation)
    require_limit(limit, 500)
    out = f"{aggregation}_{metric}"
    read = {"count": value, "sum": summand}.get(aggregation, number)
    values = read(df, metric)
    grouped = grouped_measure(df, {group_by: value(df, group_by)}, values, aggregation, out)
    ordered = grouped.orderBy(col(out).desc_nulls_last(), col(group_by).asc_nulls_last())
    return ordered if limit is None else ordered.limit(limit)


def _measure(df: DataFrame, name: str) -> Column:
    """The measures every sales table is built from."""
    if name == "revenue":
        built = total(number(df, "revenue"))
    elif name == "qty":
        built = F.coalesce(F.sum(number(df, "qty")), F.lit(0)).cast("long")
    elif name == "orders":
        built = F.countDistinct(col("order_id"))
    elif name == "rows":
        built = F.count(col("order_id"))
    elif name == "cancelled_rows":
        built = F.coalesce(F.sum(col("is_cancelled").cast("long")), F.lit(0))
    elif name == "cancel_rate":
        built = F.avg(col("is_cancelled").cast("int"))
    elif name == "avg_amount":
        built = F.avg(number(df, "revenue"))
    else:
        raise ValueError(f"Unknown measure: {name}")
    return built.alias(name)


# Columns a measure reads.
MEASURE_INPUT = {
    "revenue": "revenue",
    "qty": "qty",
    "orders": "order_id",
    "rows": "order_id",
    "cancelled_rows": "is_cancelled",
    "cancel_rate": "is_cancelled",
    "avg_amount": "revenue",
}


def sales_summary(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    order: str | None = None,
    descending: bool = True,
    limit: int | None = None,
    having: Column | None = None,
) -> DataFrame:
    """One aggregation over line items: keys, chosen measures, an order and maybe a cut.

    Distinct orders shuffle on (keys, order_id) first, so a hot key is spread over
    the cluster before its counts meet.
    """
    require_columns(df, [*keys, *dict.fromkeys(MEASURE_INPUT[m] for m in measures)])
    grouped = df.groupBy(*[value(df, k).alias(k) for k in keys]).agg(*[_measure(df, m) for m in measures])
    if having is not None:
        grouped = grouped.where(having)
    ties = [col(k).asc_nulls_last() for k in keys]
    if order is not None:
        lead = col(order).desc_nulls_last() if descending else col(order).asc_nulls_last()
        grouped = grouped.orderBy(lead, *[t for k, t in zip(keys, ties) if k != order])
    return grouped if limit is None else grouped.limit(limit)


def _totals(grouped: DataFrame, keys: Sequence[str]) -> Column:
    """Sums of all measures over the groups.

    All of them, whichever is wanted: the subquery then is the very aggregation of the
    main plan and reuses its shuffle, instead of reading and joining the input again.
    """
    return scalar_of(grouped, *[F.sum(col(m)).alias(m) for m in grouped.columns if m not in keys])


def get_sales_overview(df: DataFrame) -> DataFrame:
    """One row of totals over the prepared line items."""
    require_columns(df, ["order_id", "date", "revenue", "qty", "is_cancelled", "amount"])
    day = F.date_format(F.min(timestamp(df, "date")), "yyyy-MM-dd"), F.date_format(F.max(timestamp(df, "date")), "yyyy-MM-dd")
    missing = F.count_if(value(df, "amount").isNull())
    overview = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.countDistinct("order_id").alias("unique_orders"),
        day[0].alias("date_min"),
        day[1].alias("date_max"),
        total(number(df, "revenue")).alias("total_revenue"),
        F.coalesce(F.sum(number(df, "qty")), F.lit(0)).cast("long").alias("total_qty"),
        F.coalesce(F.avg(col("is_cancelled").cast("int")), F.lit(0.0)).alias("cancel_rate"),
        missing.alias("missing_amount_rows"),
        percent(missing, F.count(F.lit(1))).alias("missing_amount_percent"),
    )
    gap = F.when(
        F.col("missing_amount_rows") > 0, F.concat(F.col("missing_amount_rows").cast("string"), F.lit(" rows have missing amount."))
    )
    return overview.withColumn("notes", F.array_compact(F.array(*[F.lit(n) for n in REVENUE_NOTES], gap)))


def revenue_by_month(df: DataFrame) -> DataFrame:
    return sales_summary(df, ["order_month"], ["revenue", "orders", "qty", "cancel_rate"], "order_month", descending=False)


def revenue_by_category(df: DataFrame) -> DataFrame:
    """Revenue, share of all revenue, and rates per category."""
    grouped = sales_summary(df, ["category"], ["revenue", "qty", "orders", "cancel_rate", "avg_amount"])
    everything = _totals(grouped, ["category"])
    return grouped.select(
        "category",
        "revenue",
        percent(F.col("revenue"), everything["revenue"]).alias("revenue_share"),
        "qty",
        "orders",
        "cancel_rate",
        "avg_amount",
    ).orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("category"))


def top_states_by_revenue(df: DataFrame, n: int = 10) -> DataFrame:
    require_limit(n, 100, "n")
    return sales_summary(df, ["ship_state"], ["revenue", "orders", "qty", "cancel_rate"], "revenue", limit=n)


def top_skus_by_revenue(df: DataFrame, n: int = 20) -> DataFrame:
    require_limit(n, 100, "n")
    measures = ["revenue", "qty", "orders", "cancel_rate", "avg_amount"]
    return sales_summary(df, ["sku", "category"], measures, "revenue", limit=n)


def revenue_by_size(df: DataFrame) -> DataFrame:
    return sales_summary(df, ["size"], ["revenue", "qty", "orders", "cancel_rate", "avg_amount"], "revenue")


def category_cancellation_summary(df: DataFrame) -> DataFrame:
    return sales_summary(df, ["category"], ["rows", "orders", "cancelled_rows", "cancel_rate", "revenue"], "cancel_rate")


def fulfilment_summary(df: DataFrame) -> DataFrame:
    return sales_summary(df, ["fulfilment"], ["revenue", "qty", "orders", "cancel_rate", "avg_amount"], "revenue")


def courier_summary(df: DataFrame) -> DataFrame:
    return sales_summary(df, ["courier_status"], ["rows", "revenue", "qty", "orders"], "rows")


def promotion_summary(df: DataFrame) -> DataFrame:
    """Promotion against no promotion; every row carries the caveat."""
    measures = ["revenue", "qty", "orders", "avg_amount", "cancel_rate"]
    grouped = sales_summary(df, ["has_promotion"], measures)
    return grouped.withColumn("warning", F.lit(PROMOTION_NOTE)).orderBy(
        F.desc_nulls_last("revenue"), F.asc_nulls_last("has_promotion")
    )


def b2b_summary(df: DataFrame) -> DataFrame:
    """Business against private customers, with a caveat when business orders are under 5 percent."""
    grouped = sales_summary(df, ["b2b"], ["revenue", "qty", "orders", "avg_amount", "cancel_rate"])
    business = F.sum(F.when(F.col("b2b"), F.col("orders")).otherwise(0)).alias("business")
    sums = [F.sum(col(m)).alias(m) for m in grouped.columns if m != "b2b"]
    counts = scalar_of(grouped, business, *sums)
    small = (counts["orders"] > 0) & (counts["business"] / counts["orders"] < 0.05)
    return grouped.withColumn("warning", F.when(small, F.lit(B2B_NOTE))).orderBy(
        F.desc_nulls_last("revenue"), F.asc_nulls_last("b2b")
    )


def top_cities_by_revenue(df: DataFrame, n: int = 20) -> DataFrame:
    require_limit(n, 100, "n")
    return sales_summary(df, ["ship_city", "ship_state"], ["revenue", "orders", "qty", "cancel_rate"], "revenue", limit=n)


def state_cancellation_summary(df: DataFrame, min_orders: int = 1000, n: int = 20) -> DataFrame:
    require_limit(n, 100, "n")
    if min_orders < 0:
        raise ValueError("min_orders must be non-negative.")
    measures = ["orders", "revenue", "cancel_rate", "cancelled_rows"]
    return sales_summary(df, ["ship_state"], measures, "cancel_rate", limit=n, having=F.col("orders") >= min_orders)


def cancellation_summary(df: DataFrame) -> DataFrame:
    """One row: overall cancel rate, cancelled rows, distinct cancelled orders."""
    require_columns(df, ["order_id", "is_cancelled"])
    gone = col("is_cancelled")
    return df.agg(
        F.coalesce(F.avg(gone.cast("int")), F.lit(0.0)).alias("overall_cancel_rate"),
        F.count_if(gone).alias("cancelled_rows"),
        F.countDistinct(F.when(gone, col("order_id"))).alias("cancelled_orders"),
    )


def cancellation_by_dimension(df: DataFrame, dimensions: Sequence[str] = ("category", "fulfilment")) -> DataFrame:
    """Cancel rates by several single dimensions in one scan, through grouping sets."""
    require_columns(df, ["order_id", "is_cancelled", *dimensions])
    keyed = df.select(*[value(df, d).cast("string").alias(d) for d in dimensions], "order_id", "is_cancelled")
    keys = [col(d) for d in dimensions]
    grouped = keyed.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id(*keys).alias("__set"),
        _measure(keyed, "rows"),
        _measure(keyed, "orders"),
        _measure(keyed, "cancel_rate"),
    )
    # in a set of single columns, the one bit left out of the grouping id names the column
    full = 2 ** len(dimensions) - 1
    masks = {full - 2 ** (len(dimensions) - 1 - i): d for i, d in enumerate(dimensions)}
    name, group = None, None
    for mask, d in masks.items():
        hit = F.col("__set") == mask
        name = F.when(hit, F.lit(d)) if name is None else name.when(hit, F.lit(d))
        group = F.when(hit, col(d)) if group is None else group.when(hit, col(d))
    return grouped.select(name.alias("dimension"), group.alias("group_value"), "rows", "orders", "cancel_rate").orderBy(
        "dimension", F.desc_nulls_last("cancel_rate"), F.asc_nulls_last("group_value")
    )


def lines_per_order(df: DataFrame, order: str = "order_id") -> DataFrame:
    """How many rows an order has: order count, multi-line orders, largest and mean size."""
    require_columns(df, [order])
    sizes = df.where(value(df, order).isNotNull()).groupBy(col(order)).agg(F.count(F.lit(1)).alias("lines"))
    return sizes.agg(
        F.count(F.lit(1)).alias("unique_orders"),
        F.count_if(F.col("lines") > 1).alias("multi_line_orders"),
        F.max("lines").alias("max_lines_per_order"),
        F.avg("lines").alias("avg_lines_per_order"),
    )


def lines_per_order_histogram(df: DataFrame, order: str = "order_id", limit: int | None = None) -> DataFrame:
    """Orders by their number of rows, smallest sizes first; all sizes unless ``limit`` is given."""
    require_columns(df, [order])
    sizes = df.where(value(df, order).isNotNull()).groupBy(col(order)).agg(F.count(F.lit(1)).alias("lines"))
    counted = sizes.groupBy("lines").agg(F.count(F.lit(1)).alias("orders")).orderBy("lines")
    return counted if limit is None else counted.limit(limit)


def repeated_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once, null keys included.

    A semi join against the repeated keys, not a window, so that a hot key's rows
    can be split by the adaptive skew handling.
    """
    require_columns(df, keys)
    repeated = df.groupBy(*[value(df, k).alias(f"__key{i}") for i, k in enumerate(keys)]).count().where(F.col("count") > 1)
    same = None
    for i, k in enumerate(keys):
        equal = value(df, k).eqNullSafe(F.col(f"__key{i}"))
        same = equal if same is None else same & equal
    return df.join(repeated.drop("count"), same, "left_semi")


def missing_by_group(df: DataFrame, group: str, column: str, counted: str = "order_id") -> DataFrame:
    """Rows, missing cells and their percent per group, most missing first."""
    require_columns(df, [group, column, counted])
    rows, missing = F.count(col(counted)), F.count_if(value(df, column).isNull())
    out, share = f"missing_{column}", f"missing_{column}_percent"
    grouped = df.groupBy(value(df, group).alias(group)).agg(
        rows.alias("rows"), missing.alias(out), percent(missing, rows).alias(share)
    )
    return grouped.orderBy(col(out).desc(), col(group).asc_nulls_last())


def zero_quantity_summary(df: DataFrame) -> DataFrame:
    """Rows with zero quantity, how many also lack an amount, and their revenue."""
    require_columns(df, ["qty", "amount"])
    zero = number(df, "qty") == 0
    return df.agg(
        F.count_if(zero).alias("qty_zero_rows"),
        F.count_if(zero & value(df, "amount").isNull()).alias("qty_zero_and_amount_missing"),
        total(F.when(zero, number(df, "amount"))).alias("qty_zero_revenue_sum"),
    )


def daily_summary(df: DataFrame) -> DataFrame:
    """Revenue, orders and cancel rate per timestamp in ``date``; undated rows are left out."""
    require_columns(df, ["date"])
    dated = df if is_temporal(df, "date") else df.withColumn("date", timestamp(df, "date"))
    return sales_summary(dated.where(col("date").isNotNull()), ["date"], ["revenue", "orders", "cancel_rate"], "date", False)


def top_revenue_days(df: DataFrame, n: int = 10) -> DataFrame:
    require_columns(df, ["date"])
    dated = df if is_temporal(df, "date") else df.withColumn("date", timestamp(df, "date"))
    measures = ["revenue", "orders", "cancel_rate"]
    return sales_summary(dated.where(col("date").isNotNull()), ["date"], measures, "revenue", limit=n)


def category_percent_summary(df: DataFrame) -> DataFrame:
    """Category measures with revenue share and cancel rate in percent."""
    grouped = sales_summary(df, ["category"], ["revenue", "qty", "orders", "cancel_rate"])
    everything = _totals(grouped, ["category"])
    return grouped.withColumns(
        {
            "revenue_share": F.bround(F.try_divide(F.col("revenue"), everything["revenue"]) * 100, 2),
            "cancel_rate_percent": F.bround(F.col("cancel_rate") * 100, 2),
        }
    ).orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("category"))


def status_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """Measures per order status with each status's share of rows."""
    grouped = sales_summary(df, [status], ["rows", "orders", "revenue", "qty"])
    everything = _totals(grouped, [status])
    share = percent(F.col("rows"), everything["rows"])
    return grouped.withColumn("row_percent", share).orderBy(F.desc("rows"), col(status).asc_nulls_last())


def largest_rows(df: DataFrame, metric: str, n: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows with the largest metric, missing ones excluded; all columns break ties."""
    require_columns(df, [metric, *(columns or [])])
    require_metric(df, metric)
    kept = df.select(*[col(c) for c in columns]) if columns else df
    ties = [col(c).asc_nulls_last() for c in kept.columns if c != metric]
    return kept.where(value(df, metric).isNotNull()).orderBy(col(metric).desc(), *ties).limit(n)


def value_frequencies(df: DataFrame, columns: Sequence[str], limit: int = 20) -> DataFrame:
    """Most frequent values of each named column, null counted as a value."""
    from colonnade.operators.quality import top_values

    require_columns(df, columns)
    return top_values(df, columns, limit)
