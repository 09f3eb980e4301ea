"""Nearest matches, user functions and numeric checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalogue import query
from catalogue.views import OUTCOME_PROFILE, OUTCOMES_SQL, RETAIL_PROFILE, RETAIL_SQL, outcomes, retail, table
from colonnade.operators import checks, similarity, user_functions


@query(
    "best_matches",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS match_id, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, match_id) AS n FROM p)
    SELECT v.vec_id, v.label, match_id, similarity, coalesce(similarity >= 0.5, false) AS hit FROM v LEFT JOIN r ON r.vec_id = v.vec_id AND n = 1""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return similarity.best_matches(vectors, vectors, "label", "vec_id", "vec_id", "embedding", 0.5, skip_same_id=True)


@query(
    "exact_text_matches",
    """WITH s AS (SELECT lang AS dataset_id, text AS question, min(doc_id) AS match_id FROM documents GROUP BY 1, 2)
    SELECT q.doc_id, q.lang AS dataset_id, match_id, match_id IS NOT NULL AS hit FROM documents q LEFT JOIN s ON s.dataset_id = q.lang AND s.question = q.text""",
)
def _(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dataset_id"), F.col("text").alias("question"))
    stored = texts.withColumnRenamed("doc_id", "stored_id")
    return similarity.exact_text_matches(texts, stored).drop("question")


@query(
    "matches_with_fallback",
    """WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 5 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS e, vec_id % 40 AS question FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS match_id, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE a.e IS NOT NULL AND b.e IS NOT NULL),
    r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, match_id) = 1),
    s AS (SELECT label, question, min(vec_id) AS match_id FROM v GROUP BY ALL)
    SELECT v.vec_id, v.label, r.match_id, similarity, coalesce(similarity >= 0.5, false) AS hit FROM v LEFT JOIN r USING (vec_id) WHERE e IS NOT NULL
    UNION ALL SELECT v.vec_id, v.label, s.match_id, NULL, true FROM v JOIN s ON s.label = v.label AND s.question = v.question WHERE e IS NULL""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"), (F.col("vec_id") % 40).cast("string").alias("question")
    )
    return similarity.matches_with_fallback(vectors, vectors, "label", "vec_id", "vec_id", "embedding", "question", 0.5, skip_same_id=True)


@query(
    "user_function_tables",
    """WITH o AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1)
    SELECT c_custkey, c_acctbal + coalesce(spent, 0) AS worth FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
)
def _(spark, sf):
    """A user function over two tables."""

    def worth(buyers: pd.DataFrame, orders: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": buyers.c_custkey, "worth": buyers.c_acctbal + orders.o_totalprice.sum()})

    buyers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return user_functions.user_function(buyers, "cogrouped", right=orders, keys=["c_custkey"], function=worth, schema="c_custkey long, worth double")


@query(
    "user_function_split",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, round(l.l_extendedprice / t.v, 9) AS share FROM lineitem AS l
    LEFT JOIN (SELECT ps_key, sum(v) AS v FROM (SELECT l_suppkey AS ps_key, l_returnflag, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1) AS t ON l.l_suppkey = t.ps_key""",
)
def _(spark, sf):
    def share(lines: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        return lines.assign(share=(lines.l_extendedprice / totals.v.sum()).round(9))[["l_orderkey", "l_linenumber", "l_suppkey", "share"]]

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    totals = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("v"))
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, share double"
    return user_functions.user_function(lines, "cogrouped", right=totals, keys=["l_suppkey"], function=share, schema=schema, split="left")


@query(
    "user_function_batches",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 + l_tax) AS gross FROM lineitem",
)
def _(spark, sf):
    def gross(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(gross=rows.l_extendedprice * (1 + rows.l_tax))[["l_orderkey", "l_linenumber", "l_partkey", "gross"]]

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax")
    return user_functions.apply_batches(lines, gross, "l_orderkey long, l_linenumber int, l_partkey long, gross double")


@query(
    "user_function_groups",
    "SELECT l_suppkey, max(l_extendedprice) - min(l_extendedprice) AS spread, count(*) AS lines FROM lineitem GROUP BY l_suppkey",
)
def _(spark, sf):
    def shrink(rows: pd.DataFrame) -> pd.DataFrame:
        price = rows.groupby("l_suppkey", dropna=False).l_extendedprice
        return price.agg(low="min", high="max", n="size").reset_index()

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("l_suppkey", dropna=False).agg(low=("low", "min"), high=("high", "max"), n=("n", "sum")).reset_index()

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"l_suppkey": rows.l_suppkey.iloc[:1], "spread": rows.high.max() - rows.low.min(), "lines": rows.n.sum()})

    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    partial = "l_suppkey long, low double, high double, n long"
    return user_functions.apply_combined(lines, ["l_suppkey"], shrink, partial, spread, "l_suppkey long, spread double, lines long", combine)


@query(
    "user_function_combined",
    "SELECT l_returnflag, max(l_extendedprice) - min(l_extendedprice) AS spread, count(*) AS rows FROM lineitem GROUP BY l_returnflag",
)
def _(spark, sf):
    def shrink(rows: pd.DataFrame) -> pd.DataFrame:
        price = rows.groupby("l_returnflag", dropna=False).l_extendedprice
        return price.agg(low="min", high="max", n="size").reset_index()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        gap = rows.high.max() - rows.low.min()
        return pd.DataFrame({"l_returnflag": rows.l_returnflag.iloc[:1], "spread": gap, "rows": rows.n.sum()})

    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    partial = "l_returnflag string, low double, high double, n long"

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("l_returnflag", dropna=False).agg(low=("low", "min"), high=("high", "max"), n=("n", "sum")).reset_index()

    return user_functions.apply_combined(lines, ["l_returnflag"], shrink, partial, merge, "l_returnflag string, spread double, rows long", combine)


# --- checks ---------------------------------------------------------------------------

CASES = [
    {"id": "state", "tool": "semantic_breakdown", "metric_role": "revenue", "dimension_role": "state"},
    {"id": "month", "tool": "semantic_time_series", "metric_role": "profit"},
    {"id": "outliers", "tool": "detect_outliers", "metric_role": "profit"},
    {"id": "size", "tool": "get_dataset_overview"},
]


@query(
    "expected_values",
    f"""{RETAIL_SQL}, s AS (SELECT state, sum(sales) AS v FROM retail GROUP BY 1 ORDER BY v DESC, state LIMIT 1),
    m AS (SELECT strftime(date, '%Y-%m') AS p, sum(profit) AS v FROM retail GROUP BY 1 ORDER BY 1 LIMIT 1),
    b AS (SELECT quantile_cont(profit, 0.25) AS q1, quantile_cont(profit, 0.75) AS q3 FROM retail)
    SELECT 'state' AS case_id, state AS label, 'sales' AS metric, round(v, 6) AS expected, 0.01::DOUBLE AS tolerance FROM s UNION ALL
    SELECT 'month', p, 'profit', round(v, 6), 0.01 FROM m UNION ALL
    SELECT 'outliers', NULL, 'outliers_count', CAST(count(CASE WHEN profit < q1 - 1.5 * (q3 - q1) OR profit > q3 + 1.5 * (q3 - q1) THEN 1 END) AS DOUBLE), 0.0 FROM retail, b UNION ALL
    SELECT 'size', NULL, 'rows', CAST(count(*) AS DOUBLE), 0.0 FROM retail""",
)
def _(spark, sf):
    return checks.expected_values(retail(spark, sf, "customer"), RETAIL_PROFILE, CASES)


@query(
    "expected_target_values",
    f"""{OUTCOMES_SQL}, g AS (SELECT source, avg(hit) AS v FROM outcomes GROUP BY 1 ORDER BY v DESC, source LIMIT 1)
    SELECT 'rate' AS case_id, NULL AS label, 'positive_rate' AS metric, round(avg(hit), 6) AS expected, 0.000001::DOUBLE AS tolerance FROM outcomes UNION ALL
    SELECT 'best', source, 'positive_rate', round(v, 6), 0.000001 FROM g""",
)
def _(spark, sf):
    cases = [{"id": "rate", "tool": "semantic_target_summary"}, {"id": "best", "tool": "semantic_target_summary", "dimension_role": "campaign"}]
    return checks.expected_values(outcomes(spark, sf), OUTCOME_PROFILE, cases)


@query(
    "check_join",
    """WITH e AS (SELECT l_shipdate, l_returnflag, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
    x AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS dataset, lower(l_returnflag) AS label, 'price' AS metric, v AS expected,
          CASE WHEN day(l_shipdate) <> 31 THEN v * (CASE WHEN day(l_shipdate) % 5 = 0 THEN 1.02 ELSE 1.005 END) END AS actual, 0.01::DOUBLE AS tolerance FROM e)
    SELECT *, coalesce(abs(actual - expected) <= greatest(0.01 * greatest(abs(actual), abs(expected)), 0.01), false) AS passed FROM x""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    sums = lines.groupBy("l_shipdate", "l_returnflag").agg(F.sum("l_extendedprice").alias("v"))
    keys = [F.date_format("l_shipdate", "yyyy-MM-dd").alias("dataset"), F.col("l_returnflag").alias("label"), F.lit("price").alias("metric")]
    day = F.dayofmonth("l_shipdate")
    expected = sums.select(*keys, F.col("v").alias("expected"), F.lit(0.01).alias("tolerance"))
    actual = sums.where(day != 31).select(*keys, (F.col("v") * F.when(day % 5 == 0, 1.02).otherwise(1.005)).alias("actual"))
    return checks.check_join(expected, actual)


def _run(spark, sf):
    """Order lines as a check run: one case per line."""
    status = F.when(F.col("l_linenumber") == 1, "skipped").when(F.col("l_returnflag") == "R", "failed").when(F.col("l_tax") == 0.08, "error")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lower("l_linestatus"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("dataset"),
        status.otherwise("passed").alias("status"),
        (F.col("l_extendedprice") / 100).alias("latency_ms"),
        F.when(F.col("l_linenumber") > 2, F.col("l_discount") < 0.09).alias("domain"),
        (F.col("l_quantity") > 5).alias("metric_role"),
        F.when(F.col("l_linenumber") < 4, F.col("l_tax") < 0.07).alias("dimension_role"),
        (F.col("l_quantity") > 10).alias("intent"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") > 20).alias("tool"),
        (F.col("l_partkey") % 10 > 0).alias("numeric"),
        F.lit(None).cast("boolean").alias("answer_constraints"),
    )


RUN_SQL = """WITH run AS (SELECT l_linestatus, l_extendedprice / 100 AS ms,
  CASE WHEN l_linenumber = 1 THEN 'skipped' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_tax = 0.08 THEN 'error' ELSE 'passed' END AS status,
  CASE WHEN l_linenumber > 2 THEN CAST(l_discount < 0.09 AS INT) END AS d, CAST(l_quantity > 5 AS INT) AS mr, CASE WHEN l_linenumber < 4 THEN CAST(l_tax < 0.07 AS INT) END AS dr,
  CAST(l_quantity > 10 AS INT) AS i, CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity > 20 AS INT) END AS t, CAST(l_partkey % 10 > 0 AS INT) AS n FROM lineitem)"""
STATES = ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {{{s}}}" for s in ("passed", "failed", "error", "skipped"))


@query(
    "run_summary",
    f"""{RUN_SQL}, s AS (SELECT count(*) AS total_cases, {STATES.format(passed='passed_cases', failed='failed_cases', error='error_cases', skipped='skipped_cases')},
    avg(d) AS domain_accuracy, (sum(mr) + sum(dr)) / (count(mr) + count(dr)) AS role_mapping_accuracy, avg(i) AS intent_accuracy, avg(t) AS tool_accuracy,
    avg(n) AS numeric_accuracy, 1.0::DOUBLE AS answer_constraint_pass_rate,
    count(CASE WHEN status = 'error' THEN 1 END) / count(CASE WHEN status <> 'skipped' THEN 1 END) AS error_rate,
    round_even(avg(ms), 1) AS average_latency_ms, round_even(quantile_disc(ms, 0.95), 1) AS p95_latency_ms FROM run)
    SELECT *, error_rate <= 0.05 AND domain_accuracy >= 0.8 AND role_mapping_accuracy >= 0.75 AND intent_accuracy >= 0.8 AND tool_accuracy >= 0.8
    AND numeric_accuracy >= 0.9 AS overall_pass FROM s""",
)
def _(spark, sf):
    return checks.run_summary(_run(spark, sf))


@query(
    "run_summary_by_domain",
    f"""{RUN_SQL} SELECT lower(l_linestatus) AS domain, count(*) AS total, {STATES.format(passed='passed', failed='failed', error='errors', skipped='skipped')},
    avg(i) AS intent_accuracy, avg(t) AS tool_accuracy, avg(n) AS numeric_accuracy, round_even(avg(ms), 1) AS average_latency_ms FROM run GROUP BY 1""",
)
def _(spark, sf):
    return checks.run_summary_by_domain(_run(spark, sf))
