"""Column expressions shared by the operators.

Everything here builds JVM-side expressions from a DataFrame's schema; nothing
runs a job.  Float NaN is treated as missing throughout, because the tabular
semantics this library follows know only one kind of missing value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count")

# Texts that count as a positive outcome, by rule.
POSITIVE_TEXT = {
    "summary": ["yes", "true", "1", "1.0", "y", "accepted", "converted", "satisfied"],
    "segment": ["yes", "true", "1", "y", "accepted", "converted"],
    "insight": ["yes", "true", "1", "y", "positive", "converted", "responded"],
}

# Text layouts tried after ISO when a text column is read as a date.
DATE_LAYOUTS = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy", "M/d/yy", "M-d-yy"]
# Digits each part of a layout stands for.
LAYOUT_DIGITS = {"yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "H": "[0-9]{1,2}"}

WHITESPACE = " \t\n\r\x0b\x0c"


def col(name: str) -> Column:
    """A column reference that survives dots, spaces and backticks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numbers and booleans are summable; everything else is not."""
    return isinstance(type_of(df, name), (T.NumericType, T.BooleanType))


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.StringType, T.CharType, T.VarcharType))


#: What a cell must look like to be read as a number; a cast alone would take 12d and 0x1p3 too.
NUMBER_SHAPE = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))$"


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if is_numeric(df, name)]


def value(df: DataFrame, name: str) -> Column:
    """The column with float NaN folded into null; use it for keys and for null counts."""
    if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
        return F.nullif(col(name), F.lit(float("nan")))
    return col(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as a summable number; text that is no number becomes null."""
    kind = type_of(df, name)
    if isinstance(kind, T.BooleanType):
        return col(name).cast("int")
    if isinstance(kind, T.DecimalType):
        return col(name).cast("double")
    if isinstance(kind, T.NumericType):
        return value(df, name)
    return decimal_number(strip(col(name).cast("string")))


def is_whole_decimal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DecimalType) and kind.scale == 0


def summand(df: DataFrame, name: str) -> Column:
    """The column as :func:`number` gives it, but whole decimals as they are, so that their sums stay exact."""
    return col(name) if is_whole_decimal(type_of(df, name)) else number(df, name)


def decimal_number(text: Column) -> Column:
    """A text that is a decimal number, with an exponent or without, or infinity; null for any other."""
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def timestamp(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; what cannot be read becomes null."""
    kind = type_of(df, name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return col(name)
    if isinstance(kind, T.DateType):
        return col(name).cast("timestamp")
    if isinstance(kind, T.NumericType):  # plain numbers are nanoseconds since the epoch
        return F.timestamp_micros((value(df, name).cast("double") / 1000).cast("long"))
    text = strip(col(name).cast("string"))
    return F.coalesce(F.try_to_timestamp(text), *[read_date(text, layout) for layout in DATE_LAYOUTS])


def read_date(text: Column, layout: str) -> Column:
    """Text as a timestamp or null; two-digit years run from 1969 to 2068.

    The parser answers a bad text by way of an exception, so texts of another shape
    are kept away from it.
    """
    shape = re.sub("[A-Za-z]+", lambda part: LAYOUT_DIGITS[part.group()], layout)
    stamp = F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(layout)))
    if "yyyy" in layout:
        return stamp
    return F.when(F.year(stamp) > 2068, stamp - F.make_ym_interval(F.lit(100), F.lit(0))).otherwise(stamp)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that answers null on a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """``part / whole * 100``, 0.0 when the whole is zero or missing."""
    share = F.coalesce(ratio(part, whole) * 100, F.lit(0.0))
    return share if digits is None else rounded(share, digits)


def rounded(number_: Column, digits: int = 2) -> Column:
    """Half-even rounding, as numeric array libraries do it."""
    return F.bround(number_, digits)


def aggregate(how: str, values: Column) -> Column:
    """A metric aggregation Spark combines map-side.  An all-missing sum is zero; the others are null.

    The sixth one, ``median``, needs a plan of its own: see :mod:`colonnade.plans.measures`.
    """
    if how == "sum":
        return total(values)  # a double: whole numbers may add up to more than a long holds
    if how == "mean":
        return F.avg(values)
    if how == "min":
        return F.min(values)
    if how == "max":
        return F.max(values)
    if how == "count":
        return F.count(values)
    raise ValueError(f"Unsupported aggregation: {how}.")


def total(values: Column) -> Column:
    """A double-typed sum that is 0.0 when nothing is there to add."""
    return F.coalesce(F.sum(values.cast("double")), F.lit(0.0))


def is_positive(df: DataFrame, name: str, rule: str = "summary") -> Column:
    """Whether a cell states a positive outcome; missing cells do not."""
    kind = type_of(df, name)
    if isinstance(kind, T.BooleanType):
        flag = col(name)
    elif isinstance(kind, T.NumericType):
        flag = value(df, name) != 0 if rule == "insight" else value(df, name) == 1
    else:
        flag = F.lower(strip(col(name).cast("string"))).isin(POSITIVE_TEXT[rule])
    return F.coalesce(flag, F.lit(False))


def period_start(stamp: Column, freq: str) -> Column:
    """First day of the calendar bucket.  Grouping on a date is cheaper than on its label."""
    unit = {"D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "Y": "YEAR", "A": "YEAR"}.get(freq.upper())
    if unit is None:
        raise ValueError(f"Unsupported frequency: {freq}.")
    return stamp.cast("date") if unit == "DAY" else F.trunc(stamp.cast("date"), unit)


def period_label(start: Column, freq: str) -> Column:
    """Text of a bucket: 2024-05-01, 2024-05, 2024Q2, 2024, or a Monday/Sunday week range."""
    kind = freq.upper()
    if kind == "M":
        return F.date_format(start, "yyyy-MM")
    if kind == "Q":
        return F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string"))
    if kind in ("Y", "A"):
        return F.date_format(start, "yyyy")
    day = F.date_format(start, "yyyy-MM-dd")
    if kind == "W":
        return F.concat(day, F.lit("/"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    return day


def title_case(text: Column) -> Column:
    """Upper-cases the first letter of every run of letters, so ``dress-set 3a`` gives ``Dress-Set 3A``.

    ``initcap`` starts a word only after a space, so every other character that is no
    letter is followed by a marked space, which is taken out again.
    """
    mark = "\u0001 "
    spaced = F.regexp_replace(text, "(\\P{L})", "$1" + mark)
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))


def money(text: Column) -> Column:
    """``$1.2B`` style text as a plain number; other letters make it null."""
    digits = decimal_number(F.regexp_replace(text, "[$,BMbmkK ]", ""))
    suffix = F.regexp_extract(F.upper(text), "([BMK])", 1)
    scale = F.when(suffix == "B", 1e9).when(suffix == "M", 1e6).when(suffix == "K", 1e3).otherwise(1.0)
    return digits * scale


def first_word_title(text: Column) -> Column:
    return title_case(F.element_at(F.split(strip(text), "\\s+"), 1))


def before_colon(text: Column) -> Column:
    return F.substring_index(text, ":", 1)


def year_to_date_text(two_digit_year: Column) -> Column:
    """A two-digit model year as ``19yy-01-01``; an unreadable year counts as zero."""
    year = F.lit(1900) + F.coalesce(two_digit_year.try_cast("double").try_cast("int"), F.lit(0))
    return F.concat(year.cast("string"), F.lit("-01-01"))


def first_truthy_name(df: DataFrame, names: list[str], default: str) -> Column:
    """Name of the first column whose cell says something other than no."""
    picks = []
    for name in names:
        text = F.lower(strip(value(df, name).cast("string")))
        picks.append(F.when(text.isNotNull() & ~text.isin("", "0", "false", "nan", "no"), F.lit(name)))
    return F.coalesce(*picks, F.lit(default))


def in_range(df: DataFrame, name: str, start: str, end: str) -> Column:
    """Closed timestamp range: an end date means its midnight, so later times that day are out.

    The bounds take the column's own timestamp type, so the test reaches the scan.
    """
    kind = "timestamp_ntz" if isinstance(type_of(df, name), T.TimestampNTZType) else "timestamp"
    return timestamp(df, name).between(F.lit(start).cast(kind), F.lit(end).cast(kind))
