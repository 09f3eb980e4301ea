"""Reading the tables, cutting lineage in the shared folder, and sizes that decide how many parts are made."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def parts(spark: SparkSession, units: int, unit: int) -> int:
    """Partitions of about ``unit`` units each; no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // unit))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed now and kept in the folder of ``spark.checkpoint.dir``, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))  # unset: a test on one machine
    return df.checkpoint(eager=True)
