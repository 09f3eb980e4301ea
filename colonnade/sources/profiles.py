"""Writing a table profile: JSON folders plus a short Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTE = (
    "All figures come from deterministic aggregations over the whole table. "
    "Interpretations should be added only after looking at the results."
)


def write_profile(profile: dict[str, DataFrame], path: str, title: str, mode: str = "error") -> str:
    """Write every part as JSON under ``path`` and answer the Markdown report, which is written too."""
    for name, part in profile.items():
        part.coalesce(1).write.mode(mode).json(f"{path}/{name}")
    report = markdown_report(profile, title)
    spark: SparkSession = profile["overview"].sparkSession
    lines = spark.createDataFrame([(report,)], "value string")
    lines.coalesce(1).write.mode(mode).text(f"{path}/report")
    return report


def markdown_report(profile: dict[str, DataFrame], title: str) -> str:
    """Text over the profile rows, which are at most one per column of the table."""
    overview = profile["overview"].first()
    kinds = profile["column_types"].collect()
    missing = profile["missing"].collect()
    tips = profile["recommendations"].orderBy("position").collect()
    sections = {
        "1. Dataset Overview": [
            f"Rows: {overview['rows']}",
            f"Columns: {overview['columns']}",
            f"Duplicate rows: {overview['duplicate_rows']}",
        ],
        "2. Columns": [f"`{r['column']}`: {r['column_type']}" for r in kinds],
        "3. Missing Values": [f"`{r['column']}`: {r['missing']} missing ({r['missing_percent']}%)" for r in missing],
        "4. Recommended Analysis": [r["recommendation"] for r in tips],
    }
    parts = [f"# EDA Report: {title}"]
    for heading, items in sections.items():
        parts.append("\n".join([f"## {heading}", *[f"- {item}" for item in items]]))
    parts.append(f"## 5. Notes\n{NOTE}")
    return "\n\n".join(parts)
