from __future__ import annotations

import __spark_entry__


def test_groups_are_shrunk_before_the_shuffle(spark, tmp_path):
    """A supplier with most rows is not one pandas call: rows are aggregated in every task first."""
    rows = [(1, float(i)) for i in range(900)] + [(2, 5.0), (2, 7.5), (3, 4.0), (None, 1.0), (None, 3.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double").repartition(6).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = __spark_entry__.queries()["user_function_groups"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, 899.0, 900), (2, 2.5, 2), (3, 0.0, 1), (None, 2.0, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan
