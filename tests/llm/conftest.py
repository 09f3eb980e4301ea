from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in any column, empty, blank, repeated, tied and long texts.
ODD = [
    (None, "a null id that keeps a text of its own", "en", "s", 1),
    (9001, None, None, None, None),
    (9002, "", "en", "s", 0),
    (9003, " \t\n \x0b\r\n", "de", None, 3),
    (9004, "one", None, "s", 3),
    (9004, "one", None, "s", 3),
    (9005, "The same words here.\n" * 30, "en", "s", 600),
    (9006, "The same words here.\n" * 30, "en", "s", 600),
    (9007, "é" * 70 + " ßü " + "日本語のテキスト" * 20, "fr", "t", 300),
    (9008, "aaaa" * 200, "en", "t", 800),
    (9009, "aaaa" * 210, "en", "t", 840),
    (9010, " ".join(f"word{i % 977}" for i in range(30_000)), "en", "t", 200_000),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, odd):
    """The small table, and the odd rows."""
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd)


def wide(df, *clashing):
    """The rows with columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("_text", "_host", "_copy", "fp", "part", "shard", "kept", "count", *clashing)})
