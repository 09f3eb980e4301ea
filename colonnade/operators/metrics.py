"""User-defined metrics: an arithmetic text over columns and roles, compiled to a Spark column.

The text is parsed by Python's own ``ast``.  ``sum``, ``mean`` and ``count`` refer to
the whole table and become scalar subqueries; everything else is evaluated per row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import AGGREGATIONS, aggregate, col, is_numeric, number, ratio, total, value
from colonnade.functions.validate import at_most, require_limit
from colonnade.plans.measures import grouped_measure, overall_measures
from colonnade.plans.roles import SemanticProfile

FORMATS = ("number", "percent", "currency", "integer")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9_]*")


class ExpressionError(ValueError):
    """The metric text uses something other than numbers, names, + - * / and the four functions."""


@dataclass(frozen=True)
class Metric:
    name: str
    expression: str
    label: str = ""
    description: str | None = None
    format: str = "number"
    aggregation: str = "mean"
    required_roles: tuple[str, ...] = ()
    higher_is_better: bool = True


class Term(NamedTuple):
    """A compiled expression, and whether it varies by row."""

    column: Column
    per_row: bool


def define_metric(definition: Mapping[str, Any] | Metric) -> Metric:
    """Fill in defaults and tidy the texts of a metric definition."""
    if isinstance(definition, Metric):
        return definition
    text = lambda key, default="": str(definition.get(key) or default).strip()
    name = text("name")
    roles = definition.get("required_roles") or ()
    if isinstance(roles, str):
        roles = [r.strip() for r in roles.split(",") if r.strip()]
    return Metric(
        name=name,
        expression=text("expression"),
        label=text("label", name.replace("_", " ").title()) or name,
        description=text("description") or None,
        format=text("format", "number").lower(),
        aggregation=text("aggregation", "mean").lower(),
        required_roles=tuple(roles),
        higher_is_better=bool(definition.get("higher_is_better", True)),
    )


def find_metric(metrics: Sequence[Mapping[str, Any] | Metric], name: str) -> Metric:
    """Look a metric up by name or label, ignoring case."""
    wanted = name.strip().lower()
    for metric in map(define_metric, metrics):
        if wanted in (metric.name.lower(), metric.label.lower()):
            return metric
    raise ValueError(f"Custom metric not found: {name}")


def validate_metric(definition: Mapping[str, Any] | Metric, df: DataFrame, profile: SemanticProfile) -> list[str]:
    """Raise on a bad definition; answer warnings."""
    metric = define_metric(definition)
    if not NAME.fullmatch(metric.name):
        raise ValueError("Metric name must start with a letter and contain only letters, numbers, and underscores.")
    if metric.format not in FORMATS:
        raise ValueError(f"Unsupported metric format: {metric.format}.")
    if metric.aggregation not in AGGREGATIONS:
        raise ValueError(f"Unsupported metric aggregation: {metric.aggregation}.")
    for role in metric.required_roles:
        if role not in profile.roles:
            raise ValueError(f"Required semantic role is missing: {role}")
    used = _compile(df, profile, metric.expression)[1]
    return [] if used else ["Metric expression does not reference any dataset column or semantic role."]


def _identifier(column: str) -> str:
    """The name under which a column with odd characters can be written in a metric."""
    name = re.sub(r"_{2,}", "_", re.sub(r"[^0-9a-zA-Z_]+", "_", column.strip())).strip("_")
    if not name:
        return "column"
    return f"col_{name}" if name[0].isdigit() else name


def _variables(df: DataFrame, profile: SemanticProfile) -> dict[str, str]:
    """Names usable in a metric: numeric columns, their tidied names, then roles, which win."""
    names: dict[str, str] = {}
    for column in df.columns:
        if is_numeric(df, column):
            names[column] = column
            names.setdefault(_identifier(column), column)
    for role, match in profile.roles.items():
        if match.column in df.columns and is_numeric(df, match.column):
            names[role] = match.column
    return names


class _Compiler(ast.NodeVisitor):
    def __init__(self, df: DataFrame, names: Mapping[str, str]):
        self.df, self.names, self.used = df, names, set()

    def generic_visit(self, node: ast.AST) -> Term:
        raise ExpressionError(f"Unsupported expression element: {type(node).__name__}")

    def visit_Expression(self, node: ast.Expression) -> Term:
        return self.visit(node.body)

    def visit_Constant(self, node: ast.Constant) -> Term:
        if not isinstance(node.value, (int, float)):
            raise ExpressionError("Only numeric constants are allowed.")
        return Term(F.lit(float(node.value)), False)

    def visit_Name(self, node: ast.Name) -> Term:
        if node.id not in self.names:
            raise ExpressionError(f"Unknown variable or role: {node.id}")
        self.used.add(node.id)
        return Term(number(self.df, self.names[node.id]).cast("double"), True)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Term:
        if not isinstance(node.op, (ast.UAdd, ast.USub)):
            raise ExpressionError("Only unary + and - are allowed.")
        term = self.visit(node.operand)
        return term if isinstance(node.op, ast.UAdd) else Term(-term.column, term.per_row)

    def visit_BinOp(self, node: ast.BinOp) -> Term:
        left, right = self.visit(node.left), self.visit(node.right)
        per_row = left.per_row or right.per_row
        if isinstance(node.op, ast.Add):
            return Term(left.column + right.column, per_row)
        if isinstance(node.op, ast.Sub):
            return Term(left.column - right.column, per_row)
        if isinstance(node.op, ast.Mult):
            return Term(left.column * right.column, per_row)
        if isinstance(node.op, ast.Div):
            return Term(ratio(left.column, right.column), per_row)
        raise ExpressionError("Only +, -, *, / operators are allowed.")

    def visit_Call(self, node: ast.Call) -> Term:
        name = node.func.id if isinstance(node.func, ast.Name) else None
        if name not in ("sum", "mean", "count", "safe_div"):
            raise ExpressionError("Only safe functions are allowed: sum, mean, count, safe_div.")
        if node.keywords:
            raise ExpressionError("Keyword arguments are not allowed.")
        wanted = 2 if name == "safe_div" else 1
        if len(node.args) != wanted:
            raise ExpressionError(f"{name} requires exactly {wanted} argument{'s' if wanted > 1 else ''}.")
        terms = [self.visit(a) for a in node.args]
        if name == "safe_div":
            return Term(ratio(terms[0].column, terms[1].column), any(t.per_row for t in terms))
        return Term(self._whole_table(name, terms[0]), False)

    def _whole_table(self, name: str, term: Term) -> Column:
        if not term.per_row:
            return term.column if name != "count" else F.when(term.column.isNotNull(), 1.0).otherwise(0.0)
        rows = self.df.select(term.column.alias("x"))
        measure = {"sum": total, "mean": F.avg, "count": F.count}[name]
        return rows.agg(measure(F.col("x")).cast("double").alias("x")).scalar()


def _compile(df: DataFrame, profile: SemanticProfile, expression: str) -> tuple[Term, set[str]]:
    if not expression.strip():
        raise ExpressionError("Expression must not be empty.")
    try:
        tree = ast.parse(expression.strip(), mode="eval")
    except SyntaxError as error:
        raise ExpressionError(f"Invalid expression syntax: {error.msg}") from error
    compiler = _Compiler(df, _variables(df, profile))
    term = compiler.visit(tree)
    infinite = F.abs(term.column) == F.lit(float("inf"))
    return Term(F.when(~infinite, F.nullif(term.column, F.lit(float("nan")))), term.per_row), compiler.used


def compile_metric(df: DataFrame, profile: SemanticProfile, definition: Mapping[str, Any] | Metric) -> Term:
    """The metric as a column of ``df``; infinite and undefined results are null."""
    metric = define_metric(definition)
    validate_metric(metric, df, profile)
    return _compile(df, profile, metric.expression)[0]


def evaluate_metric(df: DataFrame, profile: SemanticProfile, definition: Mapping[str, Any] | Metric) -> DataFrame:
    """The metric's values: one per row, or a single one if it only uses whole-table functions."""
    metric = define_metric(definition)
    term = compile_metric(df, profile, metric)
    rows = df if term.per_row else df.sparkSession.range(1)
    return rows.select(term.column.alias(metric.name))


def evaluate_metric_summary(
    df: DataFrame, profile: SemanticProfile, definition: Mapping[str, Any] | Metric
) -> DataFrame:
    """One row: the aggregated value, how many rows have one, and the definition."""
    metric = define_metric(definition)
    term = compile_metric(df, profile, metric)
    values = evaluate_metric(df, profile, metric)
    x = col(metric.name)
    if not term.per_row:
        numbers = values.select(
            x.alias("value"),
            F.when(x.isNotNull(), 1).otherwise(0).cast("long").alias("valid_count"),
            F.when(x.isNull(), 1).otherwise(0).cast("long").alias("missing_count"),
        )
    else:
        counts = [F.count(x).alias("valid_count"), F.count_if(x.isNull()).alias("missing_count")]
        if metric.aggregation == "median":
            middle = overall_measures(values, {"value": x}, "median").scalar()
            numbers = values.agg(*counts).withColumn("value", middle)
        else:
            numbers = values.agg(aggregate(metric.aggregation, x).cast("double").alias("value"), *counts)
    return numbers.select(
        F.lit(metric.name).alias("name"),
        F.lit(metric.label).alias("label"),
        F.lit(metric.description).cast("string").alias("description"),
        F.lit(metric.expression).alias("expression"),
        F.lit(metric.format).alias("format"),
        F.lit(metric.aggregation).alias("aggregation"),
        "value",
        "valid_count",
        "missing_count",
        F.lit("series" if term.per_row else "scalar").alias("result_type"),
    )


def metric_samples(
    df: DataFrame, profile: SemanticProfile, definition: Mapping[str, Any] | Metric, n: int = 10
) -> DataFrame:
    """A few of the metric's values; which rows they come from is not defined."""
    return evaluate_metric(df, profile, definition).limit(n)


def metric_breakdown(
    df: DataFrame,
    profile: SemanticProfile,
    definition: Mapping[str, Any] | Metric,
    by_role: str | None = None,
    by_column: str | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """The metric evaluated per row, then aggregated by group: a mean of ratios, not a ratio of sums."""
    metric = define_metric(definition)
    require_limit(limit, 500)
    group = by_column or (profile.column(by_role) if by_role else None)
    if not group:
        raise ValueError("A valid by_role or by_column is required.")
    if group not in df.columns:
        raise ValueError(f"Group column does not exist: {group}")
    term = compile_metric(df, profile, metric)
    grouped = grouped_measure(df, {group: value(df, group)}, term.column, metric.aggregation, metric.name)
    lead = col(metric.name).desc_nulls_last() if metric.higher_is_better else col(metric.name).asc_nulls_last()
    return at_most(grouped.orderBy(lead, col(group).asc_nulls_last()), limit)
