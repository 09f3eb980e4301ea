"""Reading and writing tables: CSV with encoding fallback, Parquet, temp views, snapshots."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colonnade.functions.columns import col, decimal_number, is_text
from colonnade.sources.records import records

# Cell texts that mean "missing".
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
#: Bytes that windows-1252 leaves undefined; a file with one of them is read as latin-1.
UNDEFINED_BYTES = [0x81, 0x8D, 0x8F, 0x90, 0x9D]
# What a column may hold to be boolean.
BOOLEAN_TEXT = ["True", "TRUE", "true", "False", "FALSE", "false"]


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a table by its extension; CSV and Parquet are understood."""
    kind = _extension(path)
    if kind == ".csv":
        return read_csv(spark, path, **options)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type '{kind}'. Supported types: .csv, .parquet.")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid UTF-8, else windows-1252, else latin-1.  A byte order mark is skipped by the reader.

    The test reads lines as raw bytes on the executors and stops at the first bad one.
    """
    bad = spark.read.text(path).where(~F.is_valid_utf8("value"))
    if bad.isEmpty():
        return "UTF-8"
    pattern = "^(?:..)*(?:" + "|".join(f"{b:02X}" for b in UNDEFINED_BYTES) + ")"
    undefined = bad.where(F.hex(F.col("value").cast("binary")).rlike(pattern))
    return "windows-1252" if undefined.isEmpty() else "ISO-8859-1"


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: str | None = None,
    encoding: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV with a header.

    Give ``schema`` for large inputs; without one, the types are inferred from all
    rows in one extra pass.  ``multi_line`` allows line breaks inside quotes; files are
    still read block by block (``sources/records.py``), at the price of counting quotes first.
    """
    encoding = encoding or detect_encoding(spark, path)
    western = encoding.lower() in ("windows-1252", "cp1252")
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", "ISO-8859-1" if western else encoding)
    )
    if multi_line:
        names = reader.csv(path).columns if schema is None else StructType.fromDDL(schema).names  # of the first record
        typed = schema or ", ".join("`" + c.replace("`", "``") + "` string" for c in names)
        lines = records(spark, path, "ISO-8859-1" if western else encoding).where(~F.col("head"))
        cells = F.from_csv("value", typed, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}).alias("cells")
        df = lines.select(cells).select(*[F.col("cells").getField(c).alias(c) for c in names])
    else:
        df = reader.csv(path) if schema is None else reader.schema(schema).csv(path)
    df = _from_latin_1(df) if western else df
    return infer_types(df) if schema is None else df


def _from_latin_1(df: DataFrame) -> DataFrame:
    """Turn windows-1252 text that was read as latin-1, which Spark's reader knows, into what it says.

    The two differ in the characters 80 to 9F only.
    """
    control = [chr(c) for c in range(0x80, 0xA0) if c not in UNDEFINED_BYTES]
    meant = "".join(control).encode("latin-1").decode("cp1252")
    names = [c.translate(str.maketrans("".join(control), meant)) for c in df.columns]
    cells = [
        F.translate(col(c), "".join(control), meant) if is_text(df, c) else col(c) for c in df.columns
    ]
    return df.select(*[cell.alias(name) for cell, name in zip(cells, names)])


def infer_types(texts: DataFrame) -> DataFrame:
    """Give text columns the narrowest of bigint, double and boolean that fits every filled cell.

    Dates stay text.  Whole numbers with gaps become double, as one-pass table loaders do it.
    """
    cells = {c: F.when(~col(c).isin(MISSING_TEXT), col(c)) for c in texts.columns}
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, cell in enumerate(cells.values()):
        aggs += [
            F.count(cell).alias(f"have{i}"),
            F.count(_whole(cell)).alias(f"whole{i}"),
            F.count(decimal_number(F.trim(cell))).alias(f"real{i}"),
            F.count_if(cell.isin(BOOLEAN_TEXT)).alias(f"flag{i}"),
        ]
    row = texts.agg(*aggs).first()
    typed = []
    for i, (name, cell) in enumerate(cells.items()):
        have = row[f"have{i}"]
        if have and row[f"whole{i}"] == have == row["rows"]:
            typed.append(_whole(cell).alias(name))
        elif row[f"real{i}"] == have:
            # also an entirely empty column
            typed.append(decimal_number(F.trim(cell)).alias(name))
        elif row[f"flag{i}"] == have:
            typed.append(F.when(cell.isin(BOOLEAN_TEXT), F.lower(cell) == "true").alias(name))
        else:
            typed.append(cell.alias(name))
    return texts.select(*typed)


def _whole(cell: Column) -> Column:
    """A text of digits as a long, null for any other or one that is too large.

    A cast answers a bad text by way of an exception, so it only sees texts that it can read: of up to 18
    digits as a long, of up to 38 as a decimal.
    """
    text = F.trim(cell)
    long = F.when(text.rlike("^[+-]?[0-9]{1,18}$"), text.try_cast("bigint"))
    wide = F.when(text.rlike("^[+-]?[0-9]{19,38}$"), text.try_cast("decimal(38,0)"))
    return F.coalesce(long, F.when(wide.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")), wide).try_cast("bigint"))


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write by extension: ``.csv`` with a header, anything else Parquet."""
    writer = df.write.mode(mode)
    if _extension(path) == ".csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows of a table read from files, in the order of file names and of rows in a file.

    Nothing is sorted: rows are counted block by block, and a block's rows stay whose place, after all rows
    of the blocks before, is below ``rows``.  The same rows come out whenever the same files are read.
    ``df`` is what a reader gives, perhaps with columns chosen or computed, without joins or shuffles.
    """
    placed = df.select(
        F.struct(*[col(c) for c in df.columns]).alias("row"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),  # consecutive within a block
    )
    blocks = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    offsets = blocks.select("file", "block", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    near = offsets.where(F.col("before") < rows)
    kept = placed.join(near, ["file", "block"]).where(F.col("before") + F.col("place") - F.col("start") < rows)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def snapshot(df: DataFrame, rows: int = 0) -> DataFrame:
    """The table with trimmed column names, cut to its first ``rows`` rows if that is not zero.

    A table that is no longer a plain reading of files has no order: there any ``rows`` rows are taken.
    """
    trimmed = df.toDF(*[c.strip() for c in df.columns])
    if not rows:
        return trimmed
    try:
        return first_rows(trimmed, rows)
    except AnalysisException as unknown:
        if "_metadata" not in str(unknown):
            raise
        return trimmed.limit(rows)


def write_snapshot(df: DataFrame, path: str, rows: int = 0, mode: str = "error") -> None:
    write(snapshot(df, rows), path, mode)


def register_tables(spark: SparkSession, tables: Mapping[str, str | DataFrame]) -> list[str]:
    """Make tables available to ``spark.sql`` under their names; values are paths or DataFrames."""
    for name, table in tables.items():
        frame = table if isinstance(table, DataFrame) else read(spark, table)
        frame.createOrReplaceTempView(name)
    return sorted(tables)
