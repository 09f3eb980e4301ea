from __future__ import annotations

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from colonnade.operators import user_functions
from tests.conftest import rows


def seen(frame: pd.DataFrame) -> str:
    return f"{len(frame)} {','.join(map(str, frame.dtypes))}"


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


BIG = 2**60 + 1


def frames(spark):
    left = [(k, i, BIG + i if k != 3 else None, f"t{i}") for k in (1, 2, 3, None) for i in range(k or 5)] + [(9, i, i, None) for i in range(40)]
    right = [(k, float(i)) for k in (2, None, 4, 9) for i in range(3)]
    return spark.createDataFrame(left, "k long, i int, big long, t string"), spark.createDataFrame(right, "k long, x double")


def test_a_key_is_seen_whole_and_as_spark_shows_it(spark, small_batches):
    left, _ = frames(spark)

    def look(group: pd.DataFrame) -> pd.DataFrame:
        key = group.k.iloc[0]
        return pd.DataFrame({"k": [key], "n": [len(group)], "kinds": [seen(group)], "big": [None if group.big.isna().any() else group.big.max()]})

    schema = "k long, n int, kinds string, big long"
    got = Counter(tuple(r) for r in user_functions.apply_grouped(left, ["k"], look, schema).collect())
    spark_own = left.groupBy("k").applyInPandas(look, schema).collect()
    assert got == Counter(tuple(r) for r in spark_own) and len(got) == 5


def test_two_tables_by_key(spark, small_batches):
    left, right = frames(spark)

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        key = (a if len(a) else b).k.iloc[0]
        return pd.DataFrame({"k": [key], "n": [len(a)], "m": [len(b)], "x": [b.x.sum()]})

    schema = "k long, n int, m int, x double"
    got = Counter(tuple(r) for r in user_functions.apply_cogrouped(left, right, ["k"], look, schema).collect())
    assert got == Counter([(1, 1, 0, 0.0), (2, 2, 3, 3.0), (3, 3, 0, 0.0), (None, 5, 3, 3.0), (4, 0, 3, 3.0), (9, 40, 3, 3.0)])


@pytest.mark.parametrize("split", ["left", "right"])
def test_a_hot_key_is_no_single_call(spark, monkeypatch, split):
    monkeypatch.setattr(user_functions, "CHUNK", 50)
    hot = spark.createDataFrame([(1 if i % 3 else None, i) for i in range(900)] + [(2, 5)], "k long, i long")
    few = spark.createDataFrame([(1, 10.0), (1, 20.0), (None, 1.0), (3, 7.0)], "k long, x double")

    def add(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        many, other = (a, b) if split == "left" else (b, a)
        return pd.DataFrame({"i": many.i, "rows": len(many), "x": other.x.sum()})

    left, right = (hot, few) if split == "left" else (few, hot)
    got = user_functions.apply_cogrouped(left, right, ["k"], add, "i long, rows int, x double", split=split).collect()
    assert Counter((r.i, r.x) for r in got) == Counter([(i, 30.0 if i % 3 else 1.0) for i in range(900)] + [(5, 0.0)])
    assert max(r.rows for r in got) < 120
    with pytest.raises(ValueError):
        user_functions.apply_cogrouped(hot, few, ["k"], add, "i long", split="both")


def test_times_and_texts_pass(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, t string").withColumn("at", F.lit("2024-05-06 07:08:09").cast("timestamp")).withColumn("day", F.to_date("at"))
    later = user_functions.apply_grouped(frame, ["k"], lambda g: g.assign(at=g["at"] + pd.Timedelta(hours=1)), "k int, t string, at timestamp, day date")
    assert sorted(map(str, rows(later))) == sorted(map(str, rows(frame.withColumn("at", F.col("at") + F.expr("INTERVAL 1 HOUR")))))
    assert user_functions.apply_grouped(frame.limit(0), ["k"], lambda g: g, "k int, t string, at timestamp, day date").count() == 0


def test_null_keys_and_cells_in_the_queries(spark, tmp_path):
    lines = [(1, float(i), "A" if i % 2 else None) for i in range(90)] + [(None, None, None), (None, 3.0, "R"), (2, None, "R")]
    spark.createDataFrame(lines, "l_suppkey long, l_extendedprice double, l_returnflag string").repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("user_function_combined", "user_function_groups"):
        found = __spark_entry__.queries()[name](spark, str(tmp_path))
        assert Counter(tuple(r) for r in found.collect()) == Counter(db.execute(__spark_entry__.oracle_sql()[name]).fetchall()), name
