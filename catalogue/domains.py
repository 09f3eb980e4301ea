"""Role-driven, retail, marketing and workforce operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.views import (
    OUTCOME_PROFILE,
    OUTCOMES_SQL,
    PEOPLE_PROFILE,
    PEOPLE_SQL,
    RETAIL_PROFILE,
    RETAIL_SQL,
    outcomes,
    people,
    retail,
    table,
)
from colonnade.operators import domain, semantic
from colonnade.plans.roles import profile_of


@query("semantic_overview", "SELECT 'retail' AS domain, count(*) AS rows, 7 AS columns, 'revenue=sales,category=category' AS roles FROM lineitem")
def _(spark, sf):
    overview = semantic.semantic_overview(retail(spark, sf), profile_of("retail", revenue="sales", category="category"))
    joined = F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit("="), r["column"])), ",")
    return overview.withColumn("roles", joined).drop("warnings")


@query(
    "semantic_kpis",
    f"{RETAIL_SQL} SELECT count(*) AS rows, sum(sales) AS revenue, sum(profit) AS profit, sum(qty) AS quantity FROM retail",
)
def _(spark, sf):
    return semantic.semantic_kpis(retail(spark, sf), RETAIL_PROFILE).drop("columns", "warnings")


@query(
    "semantic_time_series",
    f"{RETAIL_SQL} SELECT strftime(date, '%Y-%m') AS period, sum(profit) AS profit FROM retail WHERE date IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    return semantic.semantic_time_series(retail(spark, sf), RETAIL_PROFILE, "profit")


@query(
    "semantic_breakdown",
    f"{RETAIL_SQL} SELECT state, coalesce(sum(sales), 0) AS sales FROM retail GROUP BY state ORDER BY 2 DESC, state LIMIT 20",
)
def _(spark, sf):
    return semantic.semantic_breakdown(retail(spark, sf, "customer"), RETAIL_PROFILE, "state")


@query("semantic_target_rate", f"{OUTCOMES_SQL} SELECT 'quality_label' AS target_column, avg(hit) AS positive_rate FROM outcomes")
def _(spark, sf):
    return semantic.semantic_target_rate(outcomes(spark, sf), OUTCOME_PROFILE)


@query(
    "semantic_target_summary",
    f"""{OUTCOMES_SQL} SELECT source, count(quality_label) AS rows, avg(hit) AS positive_rate FROM outcomes
    GROUP BY source ORDER BY positive_rate DESC, source LIMIT 20""",
)
def _(spark, sf):
    return semantic.semantic_target_summary(outcomes(spark, sf), OUTCOME_PROFILE, "campaign")


@query(
    "target_by_itself",
    f"""{OUTCOMES_SQL} SELECT toxic, count(toxic) AS rows, avg(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS positive_rate FROM outcomes GROUP BY toxic""",
)
def _(spark, sf):
    profile = profile_of("marketing", target="toxic", conversion="toxic")
    return semantic.semantic_target_summary(outcomes(spark, sf), profile, "conversion")


# --- retail ---------------------------------------------------------------------------

MONEY = "sum(sales) AS revenue, sum(profit) AS profit"
MARGIN = "sum(profit) / nullif(sum(sales), 0) AS margin"


@query(
    "retail_margin_summary",
    f"{RETAIL_SQL} SELECT sum(sales) AS total_revenue, sum(profit) AS total_profit, {MARGIN}, count(CASE WHEN profit < 0 THEN 1 END) AS loss_rows FROM retail",
)
def _(spark, sf):
    return domain.retail_margin_summary(retail(spark, sf), RETAIL_PROFILE)


@query(
    "retail_loss_analysis",
    f"""{RETAIL_SQL} SELECT state, {MONEY}, count(profit) AS rows, {MARGIN} FROM retail GROUP BY state HAVING sum(profit) < 0
    ORDER BY profit, state LIMIT 20""",
)
def _(spark, sf):
    lossy = retail(spark, sf, "customer")
    return domain.retail_loss_analysis(lossy, RETAIL_PROFILE, "state")


@query(
    "retail_loss_by_month",
    f"""{RETAIL_SQL}, m AS (SELECT strftime(date, '%Y-%m-%d') AS day, sales, profit FROM retail)
    SELECT day, {MONEY}, count(profit) AS rows, {MARGIN} FROM m GROUP BY day HAVING sum(profit) < 0 ORDER BY profit, day LIMIT 20""",
)
def _(spark, sf):
    days = retail(spark, sf).withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    return domain.retail_loss_analysis(days, profile_of("retail", revenue="sales", profit="profit", category="day"))


BANDS = """(VALUES (0, '0'), (1, '0-10%'), (2, '10-20%'), (3, '20-40%'), (4, '40%+')) b(band_index, discount_band)"""


@query(
    "retail_discount_effect",
    f"""{RETAIL_SQL}, x AS (SELECT *, CASE WHEN coalesce(discount, 0) * 2 <= 0 THEN 0 WHEN discount * 2 <= 0.1 THEN 1 WHEN discount * 2 <= 0.2 THEN 2
      WHEN discount * 2 <= 0.4 THEN 3 ELSE 4 END AS band, discount * 2 AS off FROM retail)
    SELECT band_index, discount_band, count(off) AS rows, avg(off) AS avg_discount, coalesce(sum(sales), 0) AS revenue,
    coalesce(sum(profit), 0) AS profit, sum(profit) / nullif(sum(sales), 0) AS margin
    FROM {BANDS} LEFT JOIN x ON band = band_index GROUP BY 1, 2""",
)
def _(spark, sf):
    doubled = retail(spark, sf).withColumn("discount", F.col("discount") * 2)
    return domain.retail_discount_effect(doubled, RETAIL_PROFILE)


@query(
    "retail_interaction",
    f"""{RETAIL_SQL} SELECT segment, state, category, {MONEY}, count(sales) AS rows, {MARGIN} FROM retail GROUP BY 1, 2, 3
    ORDER BY revenue DESC, segment, state, category LIMIT 30""",
)
def _(spark, sf):
    return domain.retail_interaction(retail(spark, sf, "customer"), RETAIL_PROFILE)


@query(
    "retail_top_opportunities",
    f"""{RETAIL_SQL}, g AS (SELECT brand, {MONEY}, count(brand) AS rows, {MARGIN} FROM retail GROUP BY 1)
    SELECT * FROM g WHERE revenue >= (SELECT quantile_cont(revenue, 0.6) FROM g) ORDER BY margin, revenue DESC, brand LIMIT 20""",
)
def _(spark, sf):
    profile = profile_of("retail", revenue="sales", profit="profit", category="brand")
    return domain.retail_top_opportunities(retail(spark, sf), profile)


# --- marketing ------------------------------------------------------------------------


def _rates(keys: str, rate: str = "positive_rate", tail: str = "") -> str:
    return f"SELECT {keys}, count(quality_label) AS rows, avg(hit) AS {rate}, CAST(sum(hit) AS BIGINT) AS positives FROM outcomes GROUP BY {keys} {tail}"


@query("marketing_response_by_segment", f"{OUTCOMES_SQL} {_rates('lang', tail='ORDER BY positive_rate DESC, rows DESC, lang LIMIT 20')}")
def _(spark, sf):
    return domain.marketing_response_by_segment(outcomes(spark, sf), OUTCOME_PROFILE)


@query(
    "marketing_campaign_response",
    f"{OUTCOMES_SQL} {_rates('source', tail='ORDER BY positive_rate DESC, rows DESC, source LIMIT 20')}",
)
def _(spark, sf):
    return domain.marketing_campaign_acceptance(outcomes(spark, sf), OUTCOME_PROFILE)


ACCEPTED = {
    "AcceptedCmp1": "web > 2",
    "AcceptedCmp2": "catalog = 1",
    "AcceptedCmp3": "recency > 100",
}


@query(
    "marketing_campaign_acceptance",
    PEOPLE_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS campaign, count(CASE WHEN {test} THEN 1 END) / count(*) AS acceptance_rate, "
        f"count(CASE WHEN {test} THEN 1 END) AS accepted, count(*) AS rows FROM people"
        for c, test in ACCEPTED.items()
    ),
)
def _(spark, sf):
    return domain.marketing_campaign_acceptance(people(spark, sf), PEOPLE_PROFILE)


@query(
    "marketing_rfm_statistics",
    PEOPLE_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS measure, avg({c}) AS mean, median({c}) AS median FROM people" for c in ("recency", "monetary", "frequency")
    ),
)
def _(spark, sf):
    return domain.marketing_rfm_statistics(people(spark, sf), PEOPLE_PROFILE)


def _bands_sql(metric: str, order: str, bands: int, measures: str) -> str:
    """Band of rank r among n: the smallest k with r <= 1 + (n - 1) * k / q."""
    return f"""{PEOPLE_SQL}, ranked AS (
      SELECT *, row_number() OVER (ORDER BY {order}) AS r, count(*) OVER () AS n,
             least({bands}, (SELECT count(DISTINCT {metric}) FROM people)) AS q FROM people WHERE {metric} IS NOT NULL
    ), banded AS (
      SELECT *, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((r - 1) * q / (n - 1))) END AS INTEGER) AS band_index FROM ranked
      UNION ALL SELECT *, NULL, NULL, NULL, NULL FROM people WHERE {metric} IS NULL
    ) SELECT band_index, min({metric}) AS band_low, max({metric}) AS band_high, {measures} FROM banded GROUP BY band_index"""


@query(
    "marketing_rfm_summary",
    _bands_sql(
        "monetary", "monetary, frequency", 4,
        "count(monetary) AS customers, avg(monetary) AS avg_monetary, avg(frequency) AS avg_frequency",
    ),
)
def _(spark, sf):
    return domain.marketing_rfm_summary(people(spark, sf), PEOPLE_PROFILE)


def _income_sql(rate: str) -> str:
    order = "income, hit, (\"left\" IS NOT NULL)"
    return _bands_sql("income", order, 5, f"count(\"left\") AS rows, avg(hit) AS {rate}, avg(income) AS avg_income")


@query("marketing_income_band_response", _income_sql("positive_rate"))
def _(spark, sf):
    return domain.marketing_income_band_response(people(spark, sf), PEOPLE_PROFILE)


@query(
    "marketing_purchase_channels",
    PEOPLE_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, CAST(sum({c}) AS DOUBLE) AS total_purchases, avg({c}) AS avg_purchases FROM people"
        for c in ("web", "catalog", "store", "deals")
    ),
)
def _(spark, sf):
    return domain.marketing_purchase_channel_summary(people(spark, sf))


# --- workforce ------------------------------------------------------------------------


@query(
    "hr_attrition_by_role",
    f"""{PEOPLE_SQL}, g AS (SELECT department, count("left") AS rows, avg(hit) AS positive_rate, CAST(sum(hit) AS BIGINT) AS positives
      FROM people GROUP BY 1 ORDER BY positive_rate DESC, rows DESC, department)
    SELECT * FROM g WHERE rows >= 40 ORDER BY positive_rate DESC, rows DESC, department LIMIT 20""",
)
def _(spark, sf):
    return domain.hr_attrition_by_role(people(spark, sf), PEOPLE_PROFILE, "department", min_rows=40)


@query("hr_income_band_attrition", _income_sql("attrition_rate"))
def _(spark, sf):
    return domain.hr_income_band_attrition(people(spark, sf), PEOPLE_PROFILE)


TENURE = """(VALUES (0, '<=1'), (1, '1-3'), (2, '3-5'), (3, '5-10'), (4, '10+')) b(band_index, tenure_band)"""


@query(
    "hr_tenure_risk",
    f"""{PEOPLE_SQL}, x AS (SELECT *, CASE WHEN tenure <= 1 THEN 0 WHEN tenure <= 3 THEN 1 WHEN tenure <= 5 THEN 2 WHEN tenure <= 10 THEN 3
      WHEN tenure IS NOT NULL THEN 4 END AS band FROM people)
    SELECT band_index, tenure_band, count("left") AS rows, avg(hit) AS attrition_rate, avg(tenure) AS avg_tenure
    FROM {TENURE} LEFT JOIN x ON band = band_index GROUP BY 1, 2
    UNION ALL SELECT NULL, NULL, count("left"), avg(hit), avg(tenure) FROM x WHERE band IS NULL HAVING count(*) > 0""",
)
def _(spark, sf):
    return domain.hr_tenure_risk(people(spark, sf), PEOPLE_PROFILE)


@query(
    "hr_high_risk_segments",
    f"""{PEOPLE_SQL} SELECT department, segment, overtime, count("left") AS rows, avg(hit) AS attrition_rate FROM people
    GROUP BY 1, 2, 3 HAVING count("left") >= 3 ORDER BY attrition_rate DESC, rows DESC, department, segment, overtime LIMIT 20""",
)
def _(spark, sf):
    return domain.hr_high_risk_segments(people(spark, sf), PEOPLE_PROFILE, min_rows=3)


@query(
    "target_group_events",
    """SELECT user_id, count(event_type) AS rows, avg(CASE WHEN lower(event_type) = 'converted' OR value = 1 THEN 1.0 ELSE 0.0 END) AS positive_rate,
    CAST(sum(CASE WHEN lower(event_type) = 'converted' OR value = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives
    FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'Converted' ELSE event_type END AS event_type, 0 AS value FROM events)
    GROUP BY 1 ORDER BY positive_rate DESC, rows DESC, user_id LIMIT 20""",
)
def _(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "Converted").otherwise(F.col("event_type"))
    events = table(spark, sf, "events").select("user_id", kind.alias("event_type"))
    return domain.target_group(events, "event_type", ["user_id"])
