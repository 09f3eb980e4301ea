from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def large(spark, monkeypatch):
    """Make a few rows count as many: several slices, and brackets that are narrowed by samples."""
    from colonnade.plans import quantiles, scale

    for name, value in {"DIRECT_ROWS": 20, "BRACKET_ROWS": 10, "SAMPLE_ROWS": 50, "SAMPLE_MARGIN": 0.1}.items():
        monkeypatch.setattr(quantiles, name, value)
    monkeypatch.setattr(scale, "SLICE_ROWS", 3)


@pytest.fixture(params=["small", "large"])
def size(request):
    """Run a test as it is, and with many slices and brackets."""
    if request.param == "large":
        request.getfixturevalue("large")
    return request.param


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def only(df) -> dict:
    found = rows(df)
    assert len(found) == 1, found
    return found[0]


def by(df, key: str) -> dict:
    return {r[key]: r for r in rows(df)}
