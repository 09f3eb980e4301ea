"""Contribution ranking, cumulative shares and value bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.functions.columns import col, number, percent, rounded, total, value
from colonnade.functions.validate import require_columns, require_metric
from colonnade.plans.measures import scalar_of
from colonnade.plans.scale import materialize, with_running_sum

PARETO_PERCENT = 80


def group_totals(df: DataFrame, group: str, metric: str) -> DataFrame:
    require_columns(df, [group, metric])
    require_metric(df, metric)
    keyed = df.select(value(df, group).alias("__group"), number(df, metric).alias("__metric"))
    return keyed.groupBy(F.col("__group").alias(group)).agg(total(F.col("__metric")).alias("total_value"))


def top_bottom_contributors(df: DataFrame, group_column: str, metric_column: str, n: int = 5) -> DataFrame:
    """The ``n`` largest and ``n`` smallest groups with their percent of the grand total.

    ``side`` is top or bottom; position one of the bottom side is the smallest group.
    Both sides are top-k selections over one shared aggregation.
    """
    grouped = group_totals(df, group_column, metric_column)
    grand = scalar_of(grouped, F.sum("total_value").alias("sum"))["sum"]
    up, down = F.col("total_value").desc(), F.col("total_value").asc()
    top = grouped.orderBy(up, col(group_column).asc_nulls_last()).limit(n)
    bottom = grouped.orderBy(down, col(group_column).desc_nulls_first()).limit(n)
    # at most n rows on either side
    top = top.withColumn("position", F.row_number().over(Window.orderBy(up, col(group_column).asc_nulls_last())))
    bottom = bottom.withColumn("position", F.row_number().over(Window.orderBy(down, col(group_column).desc_nulls_first())))
    both = top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))
    return both.select(
        "side",
        "position",
        col(group_column),
        "total_value",
        percent(F.col("total_value"), grand).alias("contribution_percent"),
        grand.alias("total_sum"),
    )


def cumulative_totals(df: DataFrame, category_column: str, metric_column: str) -> DataFrame:
    """Group totals in falling order with running sum and running percent of the grand total."""
    # fixes the floating point sums, which the order and the running sum both depend on
    grouped = materialize(group_totals(df, category_column, metric_column))
    order = [F.col("total_value").desc(), col(category_column).asc_nulls_last()]
    running = with_running_sum(grouped, order, F.col("total_value"), "cumulative_value")
    grand = scalar_of(grouped, F.sum("total_value").alias("sum"), F.count(F.lit(1)).alias("groups"))
    return running.select(
        col(category_column),
        "total_value",
        "cumulative_value",
        rounded(F.try_divide(F.col("cumulative_value"), grand["sum"]) * 100).alias("cumulative_percent"),
        grand["sum"].alias("total_sum"),
        grand["groups"].alias("total_categories"),
    ).where(F.col("total_sum") != 0)


def pareto_analysis(df: DataFrame, category_column: str, metric_column: str) -> DataFrame:
    """Groups whose running percent stays within 80, or the first group if none does.

    Every row repeats the grand total, the number of groups and of contributors.  A
    zero grand total gives no rows.
    """
    running = cumulative_totals(df, category_column, metric_column)
    within = F.col("cumulative_percent") <= PARETO_PERCENT
    kept = scalar_of(running, F.count_if(within).alias("n"))["n"]
    first = running.orderBy(F.col("total_value").desc(), col(category_column).asc_nulls_last()).limit(1)
    chosen = running.where(within).unionByName(first.where(kept == 0))
    count = F.greatest(kept, F.lit(1))
    return chosen.select(
        "*",
        count.alias("contributors_count"),
        percent(count, F.col("total_categories")).alias("categories_percent"),
    ).orderBy(F.col("total_value").desc(), col(category_column).asc_nulls_last())


# --- value bands -----------------------------------------------------------------


def labelled_band(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands: ``labels[i]`` up to and including ``edges[i]``, the last label beyond."""
    band = F.when(x <= edges[0], F.lit(0))
    for i, edge in enumerate(edges[1:], start=1):
        band = band.when(x <= edge, F.lit(i))
    return band.when(x.isNotNull(), F.lit(len(labels) - 1))


def band_table(
    df: DataFrame, band: Column, labels: Sequence[str], aggs: Mapping[str, Column], counts: Sequence[str], label_name: str
) -> DataFrame:
    """Aggregates per fixed band, with a row for every label even when no row falls in it.

    ``counts`` names the aggregates that are zero rather than null in an empty band.
    A null band, if rows have one, comes last.
    """
    grouped = df.groupBy(band.alias("band_index")).agg(*[c.alias(n) for n, c in aggs.items()])
    names = F.array(*[F.lit(x) for x in labels])
    fixed = df.sparkSession.range(len(labels)).select(F.col("id").cast("int").alias("band_index"))
    filled = fixed.join(grouped, "band_index", "left").unionByName(grouped.where(F.col("band_index").isNull()))
    return filled.select(
        "band_index",
        F.get(names, F.col("band_index")).alias(label_name),
        *[F.coalesce(col(n), F.lit(0)).alias(n) if n in counts else col(n) for n in aggs],
    ).orderBy(F.asc_nulls_last("band_index"))


def rank_bands(df: DataFrame, metric: str, extras: Sequence[str], bands: int) -> DataFrame:
    """Split rows into equally filled bands of rising ``metric``.

    Returns counted cells: (band_index, metric, extras..., n).  Rows alike in metric
    and extras are interchangeable, so they are counted first and a cell that lies
    across a band edge is split by count.  With n ranked rows, band k ends at rank
    floor(1 + (n - 1) * k / q); q is ``bands`` or the number of distinct values if
    that is smaller.  Missing metrics form the null band.
    """
    cells = df.groupBy(col(metric), *[col(e) for e in extras]).agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells)
    ranked = cells.where(col(metric).isNotNull())
    order = [col(metric).asc(), *[col(e).asc_nulls_first() for e in extras]]
    running = with_running_sum(ranked, order, F.col("n"), "__upto")
    # at most ``bands`` distinct values matter, and their number is a plain distinct count
    size = scalar_of(
        ranked, F.sum("n").alias("n"), F.least(F.lit(bands), F.greatest(F.countDistinct(col(metric)), F.lit(1))).alias("q")
    )
    ranked_cells = running.withColumns({"__n": size["n"], "__q": size["q"]})
    before, upto, rows, q = F.col("__upto") - F.col("n"), F.col("__upto"), F.col("__n") - 1, F.col("__q")
    band_of = lambda rank: F.greatest(F.ceil(F.try_divide((rank - 1) * q, rows)), F.lit(1)).cast("int")
    last_rank = lambda k: F.when(k > 0, F.floor(1 + rows * k / q)).otherwise(F.lit(0))
    kept = [col(metric), *[col(e) for e in extras]]
    # a cell covers the ranks before+1 .. upto, and so usually one band
    spread = ranked_cells.withColumn("band_index", F.explode(F.sequence(band_of(before + 1), band_of(upto))))
    share = F.least(upto, last_rank(F.col("band_index"))) - F.greatest(before, last_rank(F.col("band_index") - 1))
    banded = spread.select("band_index", *kept, share.alias("n"))
    missing = cells.where(col(metric).isNull()).select(F.lit(None).cast("int").alias("band_index"), *kept, "n")
    return banded.unionByName(missing)


def weighted_mean(x: Column) -> Column:
    """Mean over counted cells (count column ``n``), missing values left out."""
    x = x.cast("double")
    return F.try_divide(F.sum(x * F.col("n")), F.sum(F.when(x.isNotNull(), F.col("n"))))
