"""Data-quality counts and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colonnade.functions.columns import col, is_numeric, is_temporal, is_text, number, numeric_columns, percent, read_date, value
from colonnade.functions.validate import require_columns
from colonnade.plans.quantiles import exact_quantiles

# What a column name must contain to be read as a date, and the layouts tried.
DATE_NAME_HINTS = ["date", "time", "day", "month", "year", "created", "updated"]
DATE_TEXT_LAYOUTS = ["yyyy-MM-dd", "MM-dd-yy", "MM/dd/yy", "MM-dd-yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd/MM/yyyy"]


def _stack(row: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry, on the JVM side."""
    packed = [F.struct(*[c.alias(n) for n, c in zip(names, entry)]) for entry in entries]
    return row.select(F.explode(F.array(*packed)).alias("entry")).select("entry.*")


def _hashable(df: DataFrame) -> DataFrame:
    """Rows ready for whole-row grouping: NaN folded into null, map columns refused."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.MapType, T.VariantType))]
    if maps:
        raise ValueError(f"Rows with map columns cannot be compared: {maps}")
    return df.select(*[value(df, c).alias(c) for c in df.columns])


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: all rows, and rows beyond the first of an identical full row (null equals null).

    64-bit row hashes are grouped first, which shuffles sixteen bytes a row, and full
    rows are compared only where a hash repeats, so the answer is exact.
    """
    rows = _hashable(df)
    names = [col(c) for c in rows.columns]
    hashed = rows.withColumn("__hash", F.xxhash64(*names))
    suspects = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("__hash")
    groups = hashed.join(suspects, "__hash", "left_semi").groupBy("__hash", *names).agg(F.count(F.lit(1)).alias("copies"))
    repeats = groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("duplicate_rows", repeats)


def get_duplicate_rows(df: DataFrame) -> DataFrame:
    counts = duplicate_count(df)
    return counts.select(
        "duplicate_rows",
        F.bround(F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)) * 100, 2).alias("duplicate_percent"),
    )


def get_missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percent of every column, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(value(df, c)).alias(f"have{i}") for i, c in enumerate(df.columns)]
    )
    entries = []
    for i, name in enumerate(df.columns):
        gone = F.col("rows") - F.col(f"have{i}")
        share = F.bround(F.try_divide(gone.cast("double"), F.col("rows")) * 100, 2)
        entries.append([F.lit(name), gone, share, gone > 0])
    return _stack(counts, entries, ["column", "missing", "missing_percent", "has_missing"])


def get_dataset_overview(df: DataFrame) -> DataFrame:
    """One row: shape, column names by kind, duplicate rows."""
    return duplicate_count(df).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        _names([c for c in df.columns if is_numeric(df, c)]).alias("numeric_columns"),
        _names([c for c in df.columns if is_temporal(df, c)]).alias("datetime_columns"),
        "duplicate_rows",
    )


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def get_data_quality_summary(df: DataFrame) -> DataFrame:
    """One row: duplicates, repeated order ids, and the warnings they give.

    Per-column counts are :func:`get_missing_values`.
    """
    shipping = [c for c in ("ship_city", "ship_state", "ship_country") if c in df.columns]
    counted = [c for c in ("amount", *shipping) if c in df.columns]
    aggs = [F.count_if(value(df, c).isNull()).alias(f"__no_{c}") for c in counted]
    if "order_id" in df.columns:
        any_null = F.max(F.when(col("order_id").isNull(), 1).otherwise(0))
        repeats = F.count(F.lit(1)) - F.countDistinct("order_id") - any_null
        aggs.append(F.coalesce(repeats, F.lit(0)).alias("duplicate_order_id_rows"))
    summary = df.agg(F.lit(1).alias("__one"), *aggs)
    if "order_id" not in df.columns:
        summary = summary.withColumn("duplicate_order_id_rows", F.lit(0).cast("long"))
    summary = summary.withColumn("duplicate_rows", duplicate_count(df).select("duplicate_rows").scalar())

    def note(count: str, text: str) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(text)))

    notes = []
    if "amount" in counted:
        notes.append(note("__no_amount", " rows have missing amount; revenue is calculated from available values."))
    notes += [note(f"__no_{c}", f" rows have missing {c}.") for c in shipping]
    notes.append(note("duplicate_rows", " duplicate rows were found after cleaning."))
    notes.append(
        note(
            "duplicate_order_id_rows",
            " repeated order_id rows were found; this is likely because the dataset is line-item level.",
        )
    )
    return summary.select("duplicate_rows", "duplicate_order_id_rows", F.array_compact(F.array(*notes)).alias("warnings"))


def generic_numeric_distributions(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mean, median, range and missing count of the numeric columns; of the first ``limit`` if that is given."""
    names = numeric_columns(df)[:limit]
    schema = "column string, mean double, median double, min double, max double, missing long"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    numbers = df.select(*[number(df, c).cast("double").alias(c) for c in names])
    middles = exact_quantiles(numbers, {c: [0.5] for c in names})
    counts = numbers.agg(
        *[
            agg.alias(f"{tag}{i}")
            for i, c in enumerate(names)
            for tag, agg in (
                ("mean", F.avg(col(c))),
                ("min", F.min(col(c))),
                ("max", F.max(col(c))),
                ("missing", F.count_if(col(c).isNull())),
            )
        ]
    )
    entries = [
        [
            F.lit(c),
            F.col(f"mean{i}"),
            F.lit(middles[c][0]).cast("double"),
            F.col(f"min{i}"),
            F.col(f"max{i}"),
            F.col(f"missing{i}"),
        ]
        for i, c in enumerate(names)
    ]
    return _stack(counts, entries, ["column", "mean", "median", "min", "max", "missing"])


def describe_numbers(df: DataFrame, columns: Sequence[str] | None = None, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles of numeric columns."""
    names = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, names)
    labels = [f"p{p * 100:g}".replace(".", "_") for p in probs]
    if not names:
        fields = ", ".join(f"{label} double" for label in labels)
        return df.sparkSession.createDataFrame(
            [], f"column string, count long, mean double, std double, min double, {fields}, max double"
        )
    numbers = df.select(*[number(df, c).cast("double").alias(c) for c in names])
    cuts = exact_quantiles(numbers, {c: probs for c in names})
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    counts = numbers.agg(*[f(col(c)).alias(f"{tag}{i}") for i, c in enumerate(names) for tag, f in parts.items()])
    entries = [
        [
            F.lit(c),
            *[F.col(f"{tag}{i}") for tag in ("count", "mean", "std", "min")],
            *[F.lit(q).cast("double") for q in cuts[c]],
            F.col(f"max{i}"),
        ]
        for i, c in enumerate(names)
    ]
    return _stack(counts, entries, ["column", "count", "mean", "std", "min", *labels, "max"])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Occurrences of every value of several columns in one scan: (column, value, count)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(df, c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).groupBy(
        F.col("cell.column").alias("column"), F.col("cell.value").alias("value")
    ).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """The most frequent values per column.

    The rank filter is a group limit: every task keeps its own best ``limit`` values
    per column before the shuffle, so a column of unique values stays cheap.
    """
    best = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    counts = value_counts(df, columns)
    return counts.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)


def generic_top_categorical_values(df: DataFrame, limit: int | None = None, values_per_column: int = 10) -> DataFrame:
    """Frequent values of text columns that look like categories.

    A column qualifies with more than one distinct value and at most ``max(50, rows / 2)``; all qualifying
    columns are reported, or the first ``limit``.  Columns qualify by the number of distinct hashes, so a
    free text is never shuffled; values are counted for the chosen columns only.
    """
    names = [c for c in df.columns if is_text(df, c)]
    sizes = distinct_counts(df, names) if names else {}
    chosen = [c for c, (rows, _, unique) in sizes.items() if 1 < unique <= max(50, rows * 0.5)][:limit]
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, unique long, value string, count long, position int")
    place = F.create_map(*[F.lit(x) for i, c in enumerate(chosen) for x in (c, i)])
    unique = F.create_map(*[F.lit(x) for c in chosen for x in (c, sizes[c][2])])
    ranked = top_values(df, chosen, values_per_column)
    return ranked.select(
        "column", F.element_at(unique, F.col("column")).cast("long").alias("unique"), "value", "count", "position"
    ).orderBy(F.element_at(place, F.col("column")), "position")


def distinct_counts(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[int, int, int]]:
    """(rows, filled cells, distinct values) per column, on the driver, from one pass.

    Values are told apart by 64-bit hashes, sixteen bytes a cell in the shuffle whatever they hold; two of a
    billion values collide with a chance of three percent.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.when(value(df, c).isNotNull(), F.xxhash64(value(df, c))).alias("h")) for i, c in enumerate(names)])
    counted = df.select(F.explode(cells).alias("cell")).groupBy("cell.c", "cell.h").agg(F.count(F.lit(1)).alias("n"))
    filled = F.when(F.col("h").isNotNull(), F.col("n"))
    rows = counted.groupBy("c").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"), F.count("h").alias("unique")).collect()
    found = {r["c"]: (r["rows"], r["filled"], r["unique"]) for r in rows}
    return {c: found.get(i, (0, 0, 0)) for i, c in enumerate(names)}


def infer_column_types(df: DataFrame) -> dict[str, str]:
    """Logical type of every column: numeric, datetime, categorical or text."""
    kinds: dict[str, str] = {}
    others = []
    for name in df.columns:
        if is_numeric(df, name):
            kinds[name] = "numeric"
        elif is_temporal(df, name):
            kinds[name] = "datetime"
        else:
            others.append(name)
    dated = [c for c in others if is_text(df, c) and any(h in c.lower() for h in DATE_NAME_HINTS)]
    if dated:
        kinds.update({c: "datetime" for c in _date_text_columns(df, dated)})
    rest = [c for c in others if c not in kinds]
    for name, (_, have, unique) in (distinct_counts(df, rest) if rest else {}).items():
        few = have > 0 and (unique <= 50 or unique / have <= 0.3)
        kinds[name] = "categorical" if few else "text"
    return {name: kinds[name] for name in df.columns}


def _date_text_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns whose texts mostly contain separators and mostly fit one date layout, judged on all rows at once."""
    aggs = []
    for i, name in enumerate(names):
        text = F.trim(col(name))
        share = lambda c, text=text: F.avg(F.when(text.isNotNull(), c.cast("int")))
        aggs.append(share(text.rlike("[-/]")).alias(f"s{i}"))
        aggs += [share(read_date(text, layout).isNotNull()).alias(f"l{i}_{k}") for k, layout in enumerate(DATE_TEXT_LAYOUTS)]
    row = df.agg(*aggs).first()
    return [
        name
        for i, name in enumerate(names)
        if (row[f"s{i}"] or 0) > 0.8 and max(row[f"l{i}_{k}"] or 0 for k in range(len(DATE_TEXT_LAYOUTS))) > 0.8
    ]


def column_types(df: DataFrame) -> DataFrame:
    """The inferred types as rows."""
    kinds = infer_column_types(df)
    return df.sparkSession.createDataFrame(list(kinds.items()), "column string, column_type string")


def profile_dataframe(df: DataFrame) -> dict[str, DataFrame]:
    """Full profile: overview, types, missing cells, numeric and categorical summaries, recommendations."""
    kinds = infer_column_types(df)
    spark = df.sparkSession
    categories = [c for c, k in kinds.items() if k == "categorical"]
    missing = get_missing_values(df)
    return {
        "overview": get_dataset_overview(df),
        "column_types": spark.createDataFrame(list(kinds.items()), "column string, column_type string"),
        "missing": missing,
        "numeric_summary": describe_numbers(df, [c for c, k in kinds.items() if k == "numeric"]),
        "categorical_summary": categorical_summary(df, categories),
        "recommendations": recommend_analysis(missing, kinds),
    }


def categorical_summary(df: DataFrame, columns: Sequence[str], limit: int = 5) -> DataFrame:
    """Distinct values and the most frequent ones; null is shown as ``<missing>``."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, unique_values long, value string, count long, position int")
    sizes = F.create_map(*[F.lit(x) for c, (_, _, unique) in distinct_counts(df, columns).items() for x in (c, unique)])
    return top_values(df, columns, limit).select(
        "column",
        F.element_at(sizes, F.col("column")).cast("long").alias("unique_values"),
        F.coalesce("value", F.lit("<missing>")).alias("value"),
        "count",
        "position",
    )


# Fixed values: (kinds of columns and how many of each are needed, wording with the first column of a kind).
RECOMMENDATIONS = [
    ({"datetime": 1, "numeric": 1}, "Analyze trend over time using {datetime} and {numeric}."),
    ({"categorical": 1, "numeric": 1}, "Compare {numeric} by {categorical} using a bar chart."),
    ({"numeric": 2}, "Check correlation between numeric columns."),
    ({"gap": 1}, "Review high-missing columns: {gaps}."),
]
FALLBACK = "Start with general dataset summary and missing-value analysis."
GAP_PERCENT = 20


def recommend_analysis(missing: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Suggested next steps from the column types and the missing shares (one row per suggestion)."""
    wide = {r["column"] for r in missing.where(F.col("missing_percent") > GAP_PERCENT).collect()}  # one row per column
    members: dict[str, list[str]] = {"gap": [c for c in kinds if c in wide]}
    for column, kind in kinds.items():
        members.setdefault(kind, []).append(column)
    words = {kind: names[0] for kind, names in members.items() if names} | {"gaps": ", ".join(members["gap"])}
    tips = [text.format(**words) for needs, text in RECOMMENDATIONS if all(len(members.get(k, ())) >= n for k, n in needs.items())]
    return missing.sparkSession.createDataFrame(list(enumerate(tips or [FALLBACK], start=1)), "position int, recommendation string")
