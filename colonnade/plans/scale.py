"""Building blocks that keep ordered work distributed.

Spark runs a window without partition keys, and a window over one hot key, in one task.  Here a running sum
over a total order is computed in slices, whose number follows the counted rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.functions.columns import col

#: Rows of one slice of a running sum.
SLICE_ROWS = 1_000_000


@contextmanager
def read_repeatedly(df: DataFrame) -> Iterator[DataFrame]:
    """Hold the rows on the executors, in memory and else on disk, while several jobs look at them.

    Give it a narrow projection: what is held is what the plan returns.
    """
    held = df.persist()
    try:
        yield held
    finally:
        held.unpersist()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="colonnade-"))
    else:
        raise ValueError("Set spark.checkpoint.dir to a shared folder before running on a cluster.")


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder, so a lost executor cannot change them.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have the files removed when the table is no longer used.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_running_sum(
    df: DataFrame,
    order: Sequence[Column],
    weight: Column,
    out: str,
    by: Sequence[str] = (),
    total_out: str | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` in ``order``, restarted for each ``by`` key.

    ``total_out`` names a column for the key's whole sum, if that is wanted too.

    Callers pass a materialized table whose rows are unique in (by, order), so no tie can be larger than
    one row.  Rows are range-partitioned on (by, order) into slices of about ``SLICE_ROWS`` and kept with
    their slice number; a running sum inside each slice plus the total of the slices before it gives the
    result.  Few rows are one slice.  The table of slice totals has at most one row per slice and key.
    """
    keys = [col(k) for k in by]
    upto = (Window.unboundedPreceding, Window.currentRow)
    slices = max(1, -(-df.count() // SLICE_ROWS))
    spread = df.withColumn("__weight", weight).repartitionByRange(slices, *keys, *order)
    spread = materialize(spread.withColumn("__slice", F.spark_partition_id()))
    totals = spread.groupBy(*keys, "__slice").agg(F.sum("__weight").alias("__slice_total"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[k.alias(f"__key{i}") for i, k in enumerate(keys)],
        F.col("__slice").alias("__offset_slice"),
        F.coalesce(F.sum("__slice_total").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__slice_total").over(Window.partitionBy(*keys)).alias(total_out or "__total"),
    )
    same = F.col("__slice") == F.col("__offset_slice")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__key{i}"))
    within = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(*upto)
    return (
        spread.withColumn(out, F.sum("__weight").over(within))
        .join(offsets, same)
        .withColumn(out, F.col(out) + F.col("__offset"))
        .drop("__weight", "__slice", "__offset_slice", "__offset", "__total", *[f"__key{i}" for i in range(len(keys))])
    )
