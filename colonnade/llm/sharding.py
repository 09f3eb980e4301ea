"""Sharding by jump consistent hashing.

Jump consistent hashing (Lamping and Veach, 2014) turns a stable key and a shard count into a shard without
a ring table: a generator seeded with the key jumps forward through the shard counts at which the key
moves, and the last jump below the wanted count is its shard.  With one more shard a key stays or moves
into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.llm.tables import filled, table

#: Rows that one task numbers together.
NUMBERED = 50_000
_PIECE = 10_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state, shard = keys.astype(np.uint64).copy(), np.zeros(len(keys), np.int64)
    moving, landed = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(moving):
        shard[moving] = landed
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        landed = np.floor((landed + 1) * step)
        keep = landed < shards
        moving, landed = moving[keep], landed[keep].astype(np.int64)
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key column without nulls."""

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return jumped(key)


def stable_key(docs: DataFrame, key: str) -> Column:
    """A whole number as it is, -1 for a null one; a hash of any other key."""
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(key).cast("long"), F.lit(-1)) if whole else F.xxhash64(F.col(key))


def sharded(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, its place in the shard, and its shard if there were one more.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.  Only the key and the shard count
    decide the shard; equal keys (a null is a key too) share it.  Slots run from 0 without gaps: rows of a
    shard are spread over bounded chunks by a hash of the row, numbered within the chunk, and offset by the
    counts of the earlier chunks, so no task sorts a shard.  Repeated rows are one row with a count until they
    have their slots, so no chunk is large for them.  A null text has no bytes and checksum 0.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(filled(text)) + 8).cast("long").alias("size"),
        F.crc32(filled(text)).alias("text_crc32"),
        stable_key(docs, key).alias("_key"),
    )
    chunks = max(1, -(-docs.count() // (shards * NUMBERED)))
    rows = rows.withColumns(
        {
            "shard": shard_of(F.col("_key"), shards),
            "grown_shard": shard_of(F.col("_key"), shards + 1),
            "_chunk": F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(chunks)),
        }
    )
    own = ["shard", "_chunk", "doc_id", "text_crc32", "size", "grown_shard"]
    rows = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.groupBy("shard", "_chunk").agg(F.sum("_n").alias("_n"))
    before = counts.select(
        F.col("shard"),
        F.col("_chunk"),
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_chunk")) - F.col("_n")).alias("_before"),
    )
    upto = F.sum("_n").over(Window.partitionBy("shard", "_chunk").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.col("_before") + F.col("_upto") - F.col("_n")
    # the slots of a repeated row, by pieces so that no array is long
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _PIECE))).alias("_piece")
    start = F.col("_piece") * _PIECE
    slots = F.explode(F.sequence(start, F.least(start + _PIECE, F.col("_n")) - 1)).alias("_nth")
    placed = rows.withColumn("_upto", upto).join(before, ["shard", "_chunk"]).select(*own, first.alias("_first"), "_n", pieces)
    return placed.select(*own, "_first", slots).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_first") + F.col("_nth")).cast("long").alias("slot"),
        "grown_shard",
    )


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), shards=24)
