"""Data quality, column profiles, roles and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query
from catalogue.role_sql import candidates_sql, detected_sql, warnings_sql
from catalogue.views import OUTCOMES_SQL, PEOPLE_SQL, RETAIL_PROFILE, RETAIL_SQL, SALES_SQL, outcomes, people, retail, sales, table
from colonnade.operators import insights, quality
from colonnade.plans.bundles import dashboard
from colonnade.plans.roles import build_semantic_profile, profile_of

COARSE = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


def _coarse(spark, sf):
    """Few columns of the order lines, so that full rows repeat."""
    return table(spark, sf, "lineitem").select(*COARSE)


DUPLICATES = "(SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem))"


@query(
    "dataset_overview",
    f"SELECT (SELECT count(*) FROM lineitem) AS rows, 4 AS columns, 'l_quantity,l_discount,l_returnflag,l_linestatus' AS column_names, "
    f"'l_quantity,l_discount' AS numeric_columns, '' AS datetime_columns, {DUPLICATES} AS duplicate_rows",
)
def _(spark, sf):
    overview = quality.get_dataset_overview(_coarse(spark, sf))
    lists = ("column_names", "numeric_columns", "datetime_columns")
    return overview.withColumns({c: F.array_join(c, ",") for c in lists})


def _missing_sql() -> str:
    names = ["order_id", "qty", "amount", "courier_status", "has_promotion"]
    one = (
        "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
        "round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percent, count({c}) < count(*) AS has_missing FROM sales"
    )
    return SALES_SQL + " UNION ALL ".join(one.format(c=c) for c in names)


@query("missing_values", _missing_sql())
def _(spark, sf):
    return quality.get_missing_values(sales(spark, sf, "orders").select("order_id", "qty", "amount", "courier_status", "has_promotion"))


@query(
    "duplicate_rows",
    f"SELECT {DUPLICATES} AS duplicate_rows, round_even(({DUPLICATES}) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS duplicate_percent",
)
def _(spark, sf):
    return quality.get_duplicate_rows(_coarse(spark, sf))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "numeric_distributions",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg({c}) AS mean, median({c}) AS median, min({c}) AS min, max({c}) AS max, "
        f"count(*) - count({c}) AS missing FROM lineitem"
        for c in NUMBERS
    ),
)
def _(spark, sf):
    return quality.generic_numeric_distributions(table(spark, sf, "lineitem").select(*NUMBERS))


def _describe_sql(probs: list[float]) -> str:
    cuts = ", ".join(f"quantile_cont({{c}}, {p}) AS p{p * 100:g}" for p in probs)
    one = (
        "SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
        + cuts
        + ", max({c}) AS max FROM lineitem"
    )
    return " UNION ALL ".join(one.format(c=c) for c in NUMBERS)


@query("numeric_summary", _describe_sql([0.25, 0.5, 0.75]))
def _(spark, sf):
    return quality.describe_numbers(table(spark, sf, "lineitem"), NUMBERS)


@query("percentile_describe", _describe_sql([0.01, 0.05, 0.5, 0.95, 0.99]))
def _(spark, sf):
    return quality.describe_numbers(table(spark, sf, "lineitem"), NUMBERS, (0.01, 0.05, 0.5, 0.95, 0.99))


TOP_TEXTS_SQL = OUTCOMES_SQL + """, cells AS (
  SELECT 'lang' AS "column", 0 AS o, lang AS value FROM outcomes UNION ALL SELECT 'source', 1, source FROM outcomes
  UNION ALL SELECT 'quality_label', 2, quality_label FROM outcomes UNION ALL SELECT 'short', 3, short FROM outcomes
), counted AS (SELECT "column", o, value, count(*) AS count FROM cells GROUP BY ALL),
sizes AS (SELECT "column", o, count(value) AS "unique", sum(count) AS rows FROM counted GROUP BY ALL),
chosen AS (SELECT * FROM sizes WHERE "unique" > 1 AND "unique" <= greatest(50, rows * 0.5))
SELECT "column", "unique", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value NULLS LAST) AS position
FROM counted JOIN chosen USING ("column") QUALIFY position <= 10"""


@query("top_categorical_values", TOP_TEXTS_SQL)
def _(spark, sf):
    return quality.generic_top_categorical_values(outcomes(spark, sf).select("lang", "source", "quality_label", "short"))


@query(
    "categorical_summary",
    OUTCOMES_SQL
    + """, cells AS (SELECT 'lang' AS "column", lang AS value FROM outcomes UNION ALL SELECT 'quality_label', quality_label FROM outcomes),
    counted AS (SELECT "column", value, count(*) AS count FROM cells GROUP BY ALL),
    ranked AS (SELECT *, count(value) OVER (PARTITION BY "column") AS unique_values,
               row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value NULLS LAST) AS position FROM counted)
    SELECT "column", unique_values, coalesce(value, '<missing>') AS value, count, position FROM ranked WHERE position <= 5""",
)
def _(spark, sf):
    return quality.categorical_summary(outcomes(spark, sf), ["lang", "quality_label"])


OUTCOME_KINDS = {"doc_id": "number", "lang": "text", "source": "text", "n_chars": "number", "quality_label": "text", "toxic": "number", "short": "text"}
TYPES_SQL = OUTCOMES_SQL + ", types AS (" + " UNION ALL ".join(
    f"SELECT {i} AS o, '{c}' AS \"column\", "
    + ("'numeric'" if kind == "number" else f"CASE WHEN count({c}) > 0 AND (count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / count({c}) <= 0.3) THEN 'categorical' ELSE 'text' END")
    + f" AS column_type, (count(*) - count({c})) * 100.0 / count(*) AS gap FROM outcomes"
    for i, (c, kind) in enumerate(OUTCOME_KINDS.items())
) + ") "


@query("inferred_column_types", TYPES_SQL + 'SELECT "column", column_type FROM types')
def _(spark, sf):
    return quality.column_types(outcomes(spark, sf))


@query(
    "profile_recommendations",
    TYPES_SQL
    + """, n AS (SELECT count(*) AS k, arg_min("column", o) AS first FROM types WHERE column_type = 'numeric'),
    c AS (SELECT count(*) AS k, arg_min("column", o) AS first FROM types WHERE column_type = 'categorical'),
    g AS (SELECT string_agg("column", ', ' ORDER BY o) AS gaps FROM types WHERE gap > 20),
    tips AS (SELECT 1 AS o, 'Compare ' || n.first || ' by ' || c.first || ' using a bar chart.' AS recommendation FROM n, c WHERE n.k > 0 AND c.k > 0
      UNION ALL SELECT 2, 'Check correlation between numeric columns.' FROM n WHERE k > 1
      UNION ALL SELECT 3, 'Review high-missing columns: ' || gaps || '.' FROM g WHERE gaps IS NOT NULL)
    SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS position, recommendation FROM tips""",
)
def _(spark, sf):
    return quality.profile_dataframe(outcomes(spark, sf))["recommendations"]


WHO_SQL = PEOPLE_SQL + """, who AS (SELECT id AS "ID", income, tenure, people.recency, "left", department, segment, overtime, wines AS "MntWines", meat AS "MntMeat",
  gold AS "MntGold", h.web AS "NumWebPurchases", h.catalog AS "NumCatalogPurchases", h.store AS "NumStorePurchases", h.deals AS "NumDealsPurchases",
  h.web > 2 AS "AcceptedCmp1", h.catalog AS "AcceptedCmp2", CASE WHEN people.recency > 100 THEN 'accepted' ELSE 'not accepted' END AS "AcceptedCmp3"
  FROM people LEFT JOIN history AS h ON o_custkey = id)"""
WHO_KINDS = dict.fromkeys(["ID", "income", "tenure", "recency"], "number") | dict.fromkeys(["left", "department", "segment", "overtime"], "text")
WHO_KINDS |= dict.fromkeys(["MntWines", "MntMeat", "MntGold", "NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases", "NumDealsPurchases"], "number")
WHO_KINDS |= {"AcceptedCmp1": "other", "AcceptedCmp2": "number", "AcceptedCmp3": "text"}


@query("role_candidates", candidates_sql(WHO_SQL, "who", WHO_KINDS))
def _(spark, sf):
    return build_semantic_profile(people(spark, sf)).candidates_frame(spark)


RETAIL_KINDS = dict.fromkeys(["category", "brand", "segment", "state"], "text") | {"date": "time"} | dict.fromkeys(["qty", "discount", "sales", "profit"], "number")


@query("detected_roles", detected_sql(RETAIL_SQL, "retail", RETAIL_KINDS))
def _(spark, sf):
    profile = build_semantic_profile(retail(spark, sf, "customer"))
    rows = [(profile.domain, role, m.column, m.confidence, m.source) for role, m in profile.roles.items()]
    return spark.createDataFrame(rows, "domain string, role string, column string, confidence double, source string")


PART_KINDS = {"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"}


@query("role_warnings", warnings_sql("WITH parts AS (SELECT * FROM part)", "parts", PART_KINDS))
def _(spark, sf):
    warnings = build_semantic_profile(table(spark, sf, "part")).warnings
    return spark.createDataFrame([(w,) for w in warnings], "warning string")


@query("preferred_measure", "SELECT 'l_quantity' AS metric, 'l_returnflag' AS dimension, sum(l_quantity) AS total FROM lineitem")
def _(spark, sf):
    """Without roles: the first numeric column by the first other one with two values."""
    lines = table(spark, sf, "lineitem").select("l_quantity", F.lit("same").alias("constant"), "l_returnflag")
    metric, dimension = insights.preferred_metric(lines, profile_of()), insights.preferred_dimension(lines, profile_of())
    return lines.agg(F.sum(metric[1]).alias("total")).select(F.lit(metric[0]).alias("metric"), F.lit(dimension[0]).alias("dimension"), "total")


# --- findings -------------------------------------------------------------------------

FINDING = ["type", "metric", "dimension", "label", "other_label", "value", "other_value", "share", "row_count"]


def _finding_sql(source: str, **cells: str) -> str:
    kinds = dict(type="VARCHAR", metric="VARCHAR", dimension="VARCHAR", label="VARCHAR", other_label="VARCHAR", value="DOUBLE", other_value="DOUBLE", share="DOUBLE", row_count="BIGINT")
    return "SELECT " + ", ".join(f"CAST({cells.get(c, 'NULL')} AS {kinds[c]}) AS {c}" for c in FINDING) + f" FROM {source}"


CONTRIBUTOR_SQL = f"""{RETAIL_SQL}, g AS (SELECT category, sum(sales) AS t, avg(sales) AS m FROM retail GROUP BY 1),
best AS (SELECT category, t, (SELECT sum(t) FROM g) AS every FROM g ORDER BY t DESC, category LIMIT 1) """


@query("insight_top_contributor", CONTRIBUTOR_SQL + _finding_sql("best", type="'top_contributor'", metric="'revenue'", dimension="'category'", label="category", value="t", share="t / every"))
def _(spark, sf):
    return insights.top_contributor_finding(retail(spark, sf), RETAIL_PROFILE).select(*FINDING)


@query(
    "insight_trend",
    f"""{RETAIL_SQL}, g AS (SELECT strftime(date, '%Y-%m') AS p, sum(sales) AS t FROM retail GROUP BY 1),
    e AS (SELECT arg_min(t, p) AS first, arg_max(t, p) AS last, min(p) AS fp, max(p) AS lp FROM g) """
    + _finding_sql("e", type="'trend'", metric="'revenue'", dimension="'date'", label="lp", other_label="fp", value="last", other_value="first", share="(last - first) / abs(first)"),
)
def _(spark, sf):
    return insights.trend_finding(retail(spark, sf), RETAIL_PROFILE).select(*FINDING)


@query(
    "insight_segment_gap",
    f"""{RETAIL_SQL}, g AS (SELECT category, avg(sales) AS m FROM retail GROUP BY 1),
    e AS (SELECT (SELECT category FROM g ORDER BY m DESC, category LIMIT 1) AS tl, max(m) AS tm,
          (SELECT category FROM g ORDER BY m, category LIMIT 1) AS bl, min(m) AS bm FROM g) """
    + _finding_sql("e", type="'segment_difference'", metric="'revenue'", dimension="'category'", label="tl", other_label="bl", value="tm", other_value="bm"),
)
def _(spark, sf):
    return insights.segment_gap_finding(retail(spark, sf), RETAIL_PROFILE).select(*FINDING)


@query(
    "insight_concentration",
    f"""{RETAIL_SQL}, g AS (SELECT brand, sum(sales) AS t FROM retail GROUP BY 1),
    c AS (SELECT sum(t) OVER (ORDER BY t DESC, brand ROWS UNBOUNDED PRECEDING) / sum(t) OVER () AS s FROM g),
    e AS (SELECT greatest(count(CASE WHEN s <= 0.8 THEN 1 END), 1) AS k, count(*) AS n FROM c) """
    + _finding_sql("e", type="'pareto'", metric="'revenue'", dimension="'category'", value="k", share="k / n", row_count="n"),
)
def _(spark, sf):
    profile = profile_of("retail", revenue="sales", category="brand")
    return insights.concentration_finding(retail(spark, sf), profile).select(*FINDING)


@query(
    "insight_correlation",
    "WITH c AS (SELECT corr(gross, l_extendedprice) AS r FROM (SELECT *, l_extendedprice * (1 + l_tax) AS gross FROM lineitem)) "
    + _finding_sql("c", type="'correlation'", metric="'gross'", dimension="'l_extendedprice'", value="r"),
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_tax", "l_quantity", "l_extendedprice", "l_discount")
    lines = lines.withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return insights.correlation_finding(lines).select(*FINDING)


@query(
    "insight_outlier",
    f"""WITH x AS (SELECT o_totalprice * (CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE 1 END) AS price FROM orders),
    b AS (SELECT quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS lo,
                 quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS hi FROM x),
    e AS (SELECT min(lo) AS lo, min(hi) AS hi, count(CASE WHEN price < lo OR price > hi THEN 1 END) AS n FROM x, b) """
    + _finding_sql("e", type="'outlier'", metric="'price'", value="lo", other_value="hi", row_count="n"),
)
def _(spark, sf):
    factor = F.when(F.col("o_orderkey") % 97 == 0, 9).otherwise(1)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * factor).alias("price"))
    return insights.outlier_finding(orders).select(*FINDING)


@query(
    "insight_target",
    f"""{OUTCOMES_SQL}, g AS (SELECT lang, count(toxic) AS n, avg(CASE WHEN toxic <> 0 THEN 1.0 ELSE 0.0 END) AS r FROM outcomes GROUP BY 1 HAVING count(toxic) >= 1),
    e AS (SELECT * FROM g ORDER BY r DESC, lang LIMIT 1) """
    + _finding_sql("e", type="'target_conversion'", metric="'toxic'", dimension="'country'", label="lang", value="r", row_count="n"),
)
def _(spark, sf):
    return insights.target_finding(outcomes(spark, sf), profile_of("marketing", target="toxic", country="lang")).select(*FINDING)


@query(
    "insight_data_quality",
    f"""{SALES_SQL}, thin AS (SELECT qty, nullif(courier_status, '4-NOT SPECIFIED') AS courier_status, fulfilment, 'x' AS shop FROM sales),
    m AS (SELECT 1.0 - count(courier_status) / count(*) AS gap FROM thin),
    d AS (SELECT (SELECT count(*) FROM thin) - (SELECT count(*) FROM (SELECT DISTINCT * FROM thin)) AS n, (SELECT count(*) FROM thin) AS every) """
    + _finding_sql("m WHERE gap >= 0.2", type="'data_quality'", dimension="'courier_status'", label="'missing'", value="gap")
    + " UNION ALL "
    + _finding_sql("d", type="'data_quality'", label="'duplicates'", value="n", share="n / every")
    + " UNION ALL "
    + _finding_sql("(SELECT 1)", type="'data_quality'", dimension="'shop'", label="'constant'", value="1"),
)
def _(spark, sf):
    nullable = sales(spark, sf, "orders").select("qty", F.when(F.col("courier_status") != "4-NOT SPECIFIED", F.col("courier_status")).alias("courier_status"), "fulfilment").withColumn("shop", F.lit("x"))
    return insights.data_quality_findings(nullable).select(*FINDING)


def _insights_sql() -> str:
    """All detectors over ``retail`` with its roles; there is no target."""
    names = ["category", "brand", "date", "qty", "discount", "sales", "profit"]
    numbers = ["qty", "discount", "sales", "profit"]
    gaps = " UNION ALL ".join(f"SELECT 1 - count({c}) / count(*) AS gap, '{c}' AS c FROM rows_" for c in names)
    same = " UNION ALL ".join(f"SELECT {i} AS o, '{c}' AS c FROM rows_ HAVING min({c}) = max({c})" for i, c in enumerate(names))
    fences = " UNION ALL ".join(
        f"SELECT {i} AS o, '{c}' AS c, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi, "
        f"(SELECT count(*) FROM rows_ WHERE {c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) AS n "
        f"FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM rows_)"
        for i, c in enumerate(numbers)
    )
    ordered = sorted(numbers)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rows_" for i, a in enumerate(ordered) for b in ordered[i + 1 :])

    def part(priority: int, source: str, **cells: str) -> str:
        return f"SELECT {priority} AS priority, * FROM ({_finding_sql(source, **cells)})"

    by = dict(metric="'revenue'", dimension="'category'")
    return f"""{RETAIL_SQL}, rows_ AS (SELECT {', '.join(names)} FROM retail),
    worst AS (SELECT * FROM ({gaps}) WHERE gap >= 0.2 ORDER BY gap DESC, c LIMIT 1),
    d AS (SELECT (SELECT count(*) FROM rows_) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rows_)) AS n, (SELECT count(*) FROM rows_) AS every),
    fixed AS (SELECT count(*) AS n, string_agg(c, ', ' ORDER BY o) AS c FROM ({same})),
    g AS (SELECT category, sum(sales) AS t, avg(sales) AS m FROM rows_ GROUP BY 1),
    top AS (SELECT category, t, (SELECT sum(t) FROM g) AS every FROM g ORDER BY t DESC, category LIMIT 1),
    months AS (SELECT strftime(date, '%Y-%m') AS p, sum(sales) AS t FROM rows_ GROUP BY 1),
    ends AS (SELECT arg_min(t, p) AS first, arg_max(t, p) AS last, min(p) AS fp, max(p) AS lp FROM months),
    far AS (SELECT * FROM ({fences}) WHERE n > 0 AND hi > lo ORDER BY o LIMIT 1),
    gap AS (SELECT (SELECT category FROM g ORDER BY m DESC, category LIMIT 1) AS tl, max(m) AS tm, (SELECT category FROM g ORDER BY m, category LIMIT 1) AS bl, min(m) AS bm FROM g),
    pair AS (SELECT * FROM ({pairs}) WHERE abs(r) >= 0.5 ORDER BY abs(r) DESC, a, b LIMIT 1),
    shares AS (SELECT sum(t) OVER (ORDER BY t DESC, category ROWS UNBOUNDED PRECEDING) / sum(t) OVER () AS s FROM g),
    few AS (SELECT greatest(count(CASE WHEN s <= 0.8 THEN 1 END), 1) AS k, count(*) AS n FROM shares)
    """ + " UNION ALL ".join(
        [
            part(10, "worst", type="'data_quality'", dimension="c", label="'missing'", value="gap"),
            part(11, "d WHERE n > 0", type="'data_quality'", label="'duplicates'", value="n", share="n / every"),
            part(12, "fixed WHERE n > 0", type="'data_quality'", dimension="c", label="'constant'", value="n"),
            part(20, "top", type="'top_contributor'", **by, label="category", value="t", share="t / every"),
            part(30, "ends", type="'trend'", metric="'revenue'", dimension="'date'", label="lp", other_label="fp", value="last", other_value="first", share="(last - first) / abs(first)"),
            part(40, "far", type="'outlier'", metric="c", value="lo", other_value="hi", row_count="n"),
            part(50, "gap", type="'segment_difference'", **by, label="tl", other_label="bl", value="tm", other_value="bm"),
            part(60, "pair", type="'correlation'", metric="a", dimension="b", value="r"),
            part(70, "few WHERE n >= 3", type="'pareto'", **by, value="k", share="k / n", row_count="n"),
        ]
    )


@query("insights", _insights_sql())
def _(spark, sf):
    return insights.generate_insights(retail(spark, sf), RETAIL_PROFILE).select("priority", *FINDING)


@query("dashboard_kpis", f"""{RETAIL_SQL}, k AS (SELECT count(*) AS r, sum(sales) AS s, sum(profit) AS p, sum(qty) AS q FROM retail)
SELECT 'Rows' AS label, CAST(r AS DOUBLE) AS value FROM k UNION ALL SELECT 'Revenue', s FROM k UNION ALL SELECT 'Profit', p FROM k UNION ALL SELECT 'Quantity', q FROM k""")
def _(spark, sf):
    return dashboard(retail(spark, sf, "customer"), RETAIL_PROFILE)["kpis"]
