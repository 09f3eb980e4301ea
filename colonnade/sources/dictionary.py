"""Data dictionaries: one row of metadata per column of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.columns import col, decimal_number
from colonnade.plans.roles import ROLE_WORDS

# What the fields of a dictionary may say.
DOMAINS = ["ecommerce", "retail", "marketing", "hr", "finance", "logistics", "education", "survey", "product", "generic"]
DATA_TYPES = ["string", "number", "date", "boolean", "categorical"]
AGGREGATIONS = ["sum", "mean", "count", "min", "max", "median"]
# Other headers accepted for a field.
HEADER_ALIASES = {
    "column_name": ["column", "columnname", "field", "field_name", "fieldname"],
    "business_name": ["business", "businessname", "name"],
    "semantic_role": ["role", "semantic", "semanticrole"],
    "data_type": ["type", "datatype"],
    "aggregation": ["agg"],
    "sensitive": ["is_sensitive", "issensitive"],
    "allowed_values": ["allowed", "values"],
}
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "1", "0"]
TRUE_TEXT = ["1", "true", "yes", "y", "sensitive"]
SCHEMA = (
    "domain string, column_name string, business_name string, description string, semantic_role string, "
    "data_type string, unit string, aggregation string, sensitive boolean, allowed_values array<string>"
)
FIELDS = [field.split()[0] for field in SCHEMA.split(", ")]
_CANONICAL = {alias: field for field, aliases in HEADER_ALIASES.items() for alias in aliases}


def canonical_header(header: str) -> str:
    name = header.strip().lower().replace(" ", "_").replace("-", "_")
    return _CANONICAL.get(name) or _CANONICAL.get(name.replace("_", "")) or name


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Read a ``.csv`` or ``.json`` dictionary into the common schema."""
    if path.lower().endswith(".csv"):
        raw = spark.read.option("header", True).option("escape", '"').csv(path)
    elif path.lower().endswith(".json"):
        raw = _json_fields(spark.read.option("multiLine", True).json(path))
    else:
        raise ValueError("Data dictionary must be a .csv or .json file.")
    return normalize_dictionary(raw)


def _json_fields(document: DataFrame) -> DataFrame:
    """A JSON dictionary is an object with a list of fields, or the list alone."""
    holder = next((k for k in ("fields", "columns", "schema") if k in document.columns), None)
    if holder is None:
        return document
    if not isinstance(document.schema[holder].dataType, T.ArrayType):
        raise ValueError("Data dictionary `fields` must be a list.")
    domain = F.col("domain").cast("string") if "domain" in document.columns else F.lit(None).cast("string")
    rows = document.select(domain.alias("__domain"), F.explode(holder).alias("field"))
    flat = rows.select("__domain", "field.*")
    return flat.drop("domain").withColumnRenamed("__domain", "domain")


def normalize_dictionary(raw: DataFrame) -> DataFrame:
    """Tidy headers and cells; rows without a column name are dropped."""
    headers: dict[str, str] = {}
    for name in raw.columns:
        headers[canonical_header(name)] = name

    def text(field: str, lower: bool = False) -> Column:
        if field not in headers:
            return F.lit(None).cast("string")
        cell = F.nullif(F.trim(col(headers[field]).cast("string")), F.lit(""))
        return F.lower(cell) if lower else cell

    sensitive = F.coalesce(text("sensitive", lower=True).isin(TRUE_TEXT), F.lit(False))
    if "allowed_values" in headers and isinstance(raw.schema[headers["allowed_values"]].dataType, T.ArrayType):
        parts = col(headers["allowed_values"]).cast("array<string>")
    else:
        joined = text("allowed_values")
        parts = F.when(F.contains(joined, F.lit("|")), F.split(joined, "\\|")).otherwise(F.split(joined, ","))
    values = F.filter(F.transform(parts, lambda v: F.trim(v)), lambda v: v != "")
    lowered = {"domain", "semantic_role", "data_type", "aggregation"}
    cells = {f: text(f, f in lowered) for f in FIELDS}
    cells["sensitive"] = sensitive
    cells["allowed_values"] = F.coalesce(values, F.array().cast("array<string>"))
    return raw.select(*[cells[f].alias(f) for f in FIELDS]).where(F.col("column_name").isNotNull())


def dictionary_fields(spark: SparkSession, domain: str, fields: Sequence[Mapping[str, Any]]) -> DataFrame:
    """A dictionary from plain field mappings."""
    rows = []
    for f in fields:
        values = f.get("allowed_values") or []
        rows.append(
            (
                domain,
                f["column_name"],
                f.get("business_name") or f["column_name"],
                f.get("description"),
                f.get("semantic_role"),
                f.get("data_type"),
                f.get("unit"),
                f.get("aggregation"),
                bool(f.get("sensitive", False)),
                list(values),
            )
        )
    return spark.createDataFrame(rows, SCHEMA)


def write_dictionary(dictionary: DataFrame, path: str, mode: str = "error") -> None:
    """Write the ten-column CSV form; allowed values are joined by a bar."""
    flat = dictionary.withColumn("allowed_values", F.array_join("allowed_values", "|"))
    blank = [F.coalesce(col(f).cast("string"), F.lit("")).alias(f) for f in FIELDS]
    flat.select(*blank).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def to_mapping(dictionary: DataFrame) -> dict[str, Any]:
    """The dictionary as plain values for role detection.  It has one row per column of a table."""
    rows = [r.asDict() for r in dictionary.collect()]
    domain = next((r["domain"] for r in rows if r["domain"]), None)
    return {"domain": domain, "fields": [{k: v for k, v in r.items() if k != "domain"} for r in rows]}


def validate_dictionary(dictionary: DataFrame, df: DataFrame) -> list[str]:
    """Raise on absent or repeated columns; answer warnings for unknown words."""
    content = to_mapping(dictionary)
    names = [f["column_name"] for f in content["fields"]]
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"Data dictionary references missing columns: {absent}")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"Data dictionary contains duplicate columns: {repeated}")
    warnings = []
    if content["domain"] and content["domain"] not in DOMAINS:
        warnings.append(f"Unknown domain `{content['domain']}`; it will still be saved as a user hint.")
    known = {"semantic_role": list(ROLE_WORDS), "data_type": DATA_TYPES, "aggregation": AGGREGATIONS}
    for f in content["fields"]:
        for key, words in known.items():
            if f[key] and f[key] not in words:
                warnings.append(f"Unknown {key} `{f[key]}` for column `{f['column_name']}`.")
    return warnings


def _breaks(value: Column, data_type: Column) -> Column:
    """Whether a filled cell is not of the stated type; texts and categories may be anything."""
    return (
        F.when(data_type == "number", decimal_number(F.trim(value)).isNull())
        .when(data_type == "date", F.try_to_timestamp(value).isNull())
        .when(data_type == "boolean", ~F.lower(F.trim(value)).isin(BOOLEAN_WORDS))
        .otherwise(F.lit(False))
    )


def dictionary_findings(dictionary: DataFrame, df: DataFrame) -> DataFrame:
    """What in a dictionary and its table disagrees: column_name, rule, value, rows; one row a finding.

    ``absent``: the table has no such column.  ``repeated``: several rows for one column.  ``unknown_*``: a
    domain, role, type or aggregation that is no known word.  ``disallowed``: filled cells that are none of
    the allowed values.  ``wrong_type``: filled cells that cannot be read as the stated type.  For the last
    two, which read the described columns once, ``rows`` counts cells and ``value`` is the smallest; for
    the others ``rows`` counts dictionary rows.  Of repeated rows the allowed values are taken together.

    The rules, one for each column of the table at most, are looked up while the plan is built, so that cells
    are counted where they are read: no cell is shuffled or sorted.
    """
    spark = df.sparkSession
    one = F.count(F.lit(1)).alias("rows")
    none = F.lit(None).cast("string").alias("value")
    names = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    absent = dictionary.join(names, "column_name", "left_anti").groupBy("column_name").agg(one)
    repeated = dictionary.groupBy("column_name").agg(one).where("rows > 1")

    words = {"domain": DOMAINS, "semantic_role": list(ROLE_WORDS), "data_type": DATA_TYPES, "aggregation": AGGREGATIONS}
    known = spark.createDataFrame([(f"unknown_{k}", w) for k, ws in words.items() for w in ws], "rule string, value string")
    said = F.explode(F.array(*[F.struct(F.lit(f"unknown_{k}").alias("rule"), F.col(k).alias("value")) for k in words])).alias("said")
    stated = dictionary.select("column_name", said).select(F.when(F.col("said.rule") != "unknown_domain", F.col("column_name")).alias("column_name"), "said.*")
    unknown = stated.where("value is not null").join(known, ["rule", "value"], "left_anti").groupBy("column_name", "rule", "value").agg(one)

    rules = dictionary.groupBy("column_name").agg(F.max("data_type").alias("data_type"), F.flatten(F.collect_list("allowed_values")).alias("allowed"))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    aggs, entries = [], []
    for r in rules.where(F.col("column_name").isin(plain)).collect():
        value = col(r["column_name"]).cast("string")
        broken = {"wrong_type": _breaks(value, F.lit(r["data_type"]).cast("string"))}
        if r["allowed"]:
            broken["disallowed"] = ~F.array_contains(F.lit(r["allowed"]), value)
        for rule, breaks in broken.items():
            i = len(entries)
            bad = F.when(breaks, value)  # null where the cell is
            aggs += [F.min(bad).alias(f"v{i}"), F.count(bad).alias(f"n{i}")]
            entries.append(F.struct(F.lit(r["column_name"]).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("value"), F.col(f"n{i}").alias("rows")))
    order = ["column_name", "rule", "value", "rows"]
    found = absent.select("column_name", F.lit("absent").alias("rule"), none, "rows").union(repeated.select("column_name", F.lit("repeated").alias("rule"), none, "rows"))
    found = found.union(unknown.select(*order))
    if not entries:
        return found
    wrong = df.agg(*aggs).select(F.explode(F.array(*entries)).alias("entry")).select("entry.*").where("rows > 0")
    return found.union(wrong.select(*order))


def semantic_overrides(dictionary: DataFrame) -> dict[str, Any]:
    """Domain and roles a dictionary states."""
    content = to_mapping(dictionary)
    roles = {f["semantic_role"]: f["column_name"] for f in content["fields"] if f["semantic_role"]}
    return {"domain": content["domain"], "roles": roles}
