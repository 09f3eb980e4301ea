"""Correlation, outliers and distribution shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col, number, numeric_columns, percent, value
from colonnade.functions.validate import require_columns, require_metric
from colonnade.plans.measures import scalar_of
from colonnade.plans.quantiles import exact_quantiles

PAIRS_PER_PASS = 100
PAIR_SCHEMA = "column_a string, column_b string, correlation double"


def correlation_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every unordered pair and of each column with itself.

    Pairs use the rows where both columns are present; a constant side gives null.  A
    first pass finds each column's mean, extremes and gaps.  With values shifted by
    that mean, sums of products are numerically safe, and a pair of columns without
    gaps needs just one sum.
    """
    numbers = df.select(*[number(df, c).cast("double").alias(c) for c in names])
    facts = numbers.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            f(col(c)).alias(f"{tag}{i}")
            for i, c in enumerate(names)
            for tag, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))
        ],
    ).first()
    place = {c: i for i, c in enumerate(names)}
    shifted = {c: col(c) - F.lit(facts[f"mean{i}"]).cast("double") for c, i in place.items()}
    varies = {c: facts[f"n{i}"] > 0 and facts[f"min{i}"] < facts[f"max{i}"] for c, i in place.items()}
    complete = {c for c, i in place.items() if facts[f"n{i}"] == facts["rows"]}

    def pair(a: str, b: str) -> Column:
        if not varies[a] or not varies[b]:
            return F.lit(None).cast("double")
        if a == b:
            return F.lit(1.0)
        x, y = shifted[a], shifted[b]
        if {a, b} <= complete:
            return F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))
        return _pairwise(x, y)

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start : start + PAIRS_PER_PASS]
        row = numbers.agg(*[pair(a, b).alias(f"r{i}") for i, (a, b) in enumerate(chunk)])
        cells = [
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("correlation"))
            for i, (a, b) in enumerate(chunk)
        ]
        parts.append(row.select(F.explode(F.array(*cells)).alias("pair")).select("pair.*"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _pairwise(x: Column, y: Column) -> Column:
    """Correlation of two shifted columns with gaps, over the rows that have both."""
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    n = F.count(x * y)
    varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    covered = F.sum(x * y) - F.try_divide(F.sum(xs) * F.sum(ys), n)
    spread_x = F.sum(xs * xs) - F.try_divide(F.sum(xs) * F.sum(xs), n)
    spread_y = F.sum(ys * ys) - F.try_divide(F.sum(ys) * F.sum(ys), n)
    return F.when(varies, F.try_divide(covered, F.sqrt(spread_x * spread_y)))


def correlation_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full correlation table of numeric columns, mirror and self pairs included.

    Fewer than two numeric columns give no rows.
    """
    if columns:
        require_columns(df, columns)
    names = [c for c in (columns or df.columns) if c in numeric_columns(df)]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    upper = correlation_pairs(df, names)
    sides = F.when(
        F.col("column_a") == F.col("column_b"), F.array(F.struct("column_a", "column_b"))
    ).otherwise(
        F.array(
            F.struct("column_a", "column_b"),
            F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b")),
        )
    )
    return upper.select(F.explode(sides).alias("pair"), "correlation").select("pair.*", "correlation")


def outlier_bounds(df: DataFrame, names: Sequence[str], method: str = "iqr") -> dict[str, tuple[Column, Column]]:
    """Lower and upper fence per column, null where a column has no values."""
    if method == "iqr":
        quarters = exact_quantiles(df.select(*[number(df, c).cast("double").alias(c) for c in names]), {c: [0.25, 0.75] for c in names})
        fences = {}
        for name, (q1, q3) in quarters.items():
            reach = None if q1 is None else 1.5 * (q3 - q1)
            low = None if q1 is None else q1 - reach
            high = None if q1 is None else q3 + reach
            fences[name] = (F.lit(low).cast("double"), F.lit(high).cast("double"))
        return fences
    stats = scalar_of(
        df,
        *[f(number(df, c).cast("double")).alias(f"{t}{i}") for i, c in enumerate(names) for t, f in (("m", F.avg), ("s", F.stddev_samp))],
    )
    return {c: (stats[f"m{i}"] - 3 * stats[f"s{i}"], stats[f"m{i}"] + 3 * stats[f"s{i}"]) for i, c in enumerate(names)}


def detect_outliers(df: DataFrame, metric_column: str, method: str = "iqr") -> DataFrame:
    """One row: outlier count, percent of all rows, and the fences.  ``method`` is iqr or zscore."""
    require_columns(df, [metric_column])
    require_metric(df, metric_column)
    low, high = outlier_bounds(df, [metric_column], method)[metric_column]
    x = number(df, metric_column)
    outside = F.count_if((x < low) | (x > high))
    return df.agg(outside.alias("outliers_count"), F.count(F.lit(1)).alias("rows")).select(
        F.lit(metric_column).alias("metric_column"),
        F.lit(method).alias("method"),
        "outliers_count",
        percent(F.col("outliers_count"), F.col("rows")).alias("outliers_percent"),
        low.alias("lower"),
        high.alias("upper"),
    )


def outlier_rows(df: DataFrame, metric_column: str, method: str = "iqr", limit: int | None = None) -> DataFrame:
    """Rows outside the fences; any ``limit`` of them if that is given."""
    require_columns(df, [metric_column])
    require_metric(df, metric_column)
    low, high = outlier_bounds(df, [metric_column], method)[metric_column]
    x = number(df, metric_column)
    rows = df.where((x < low) | (x > high))
    return rows if limit is None else rows.limit(limit)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes; the largest value falls in the last bin."""
    require_columns(df, [column])
    require_metric(df, column)
    x = number(df, column).cast("double")
    ends = scalar_of(df, F.min(x).alias("low"), F.max(x).alias("high"))
    width = (ends["high"] - ends["low"]) / bins
    bin_ = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - ends["low"]) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return (
        df.select(x.alias("x"))
        .where(F.col("x").isNotNull())
        .groupBy(bin_.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("bin", (ends["low"] + F.col("bin") * width).alias("bin_low"), (ends["low"] + (F.col("bin") + 1) * width).alias("bin_high"), "count")
        .orderBy("bin")
    )


def box_summary(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whisker ends (last values inside 1.5 IQR) and the number of points beyond them."""
    require_columns(df, [column])
    require_metric(df, column)
    x = number(df, column).cast("double")
    q1, q2, q3 = exact_quantiles(df.select(x.alias("x")), {"x": [0.25, 0.5, 0.75]})["x"]
    if q1 is None:
        low = high = F.lit(None).cast("double")
    else:
        low, high = F.lit(q1 - 1.5 * (q3 - q1)), F.lit(q3 + 1.5 * (q3 - q1))
    inside = F.when(x.between(low, high), x)
    return df.agg(
        F.min(x).alias("min"),
        F.min(inside).alias("lower_whisker"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q2).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.max(inside).alias("upper_whisker"),
        F.max(x).alias("max"),
        F.count_if((x < low) | (x > high)).alias("outliers"),
    )
