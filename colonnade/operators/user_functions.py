"""User pandas code over a table, run by Spark where the data is."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from colonnade.functions.columns import col
from colonnade.functions.validate import require_columns

Frame = pd.DataFrame


def apply_batches(df: DataFrame, function: Callable[[Frame], Frame], schema: str) -> DataFrame:
    """``function`` sees one Arrow batch at a time; for row-wise code."""

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


#: Rows of one key in a call, where the user lets a side be split.
CHUNK = 50_000


def _key(keys: Sequence[str]) -> Column:
    """The key as one text that is never null and differs where the key does."""
    return F.to_json(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)]))


def _as_user_sees(table: pa.Table, zone: str) -> pd.DataFrame:
    frame = table.to_pandas(integer_object_nulls=True)
    for c in frame.columns[[isinstance(t, pd.DatetimeTZDtype) for t in frame.dtypes]]:
        frame[c] = frame[c].dt.tz_convert(zone).dt.tz_localize(None)
    return frame


def _typed(rows: Frame, gappy: list[tuple[str, str]]) -> Frame:
    """Columns of whole numbers with gaps somewhere in the task: whole here if this key has none, else real."""
    if not gappy:
        return rows.reset_index(drop=True)
    return rows.assign(**{c: rows[c].astype(kind if rows[c].notna().all() else "float64") for c, kind in gappy}).reset_index(drop=True)


def _as_arrow(frames: list[Frame], schema: pa.Schema, zone: str) -> pa.Table:
    frames = [f if set(schema.names) <= set(f.columns) else f.set_axis(schema.names, axis=1) for f in frames]
    whole = pd.concat([f[schema.names] for f in frames], ignore_index=True)
    for field in schema:
        if pa.types.is_timestamp(field.type) and field.type.tz and whole[field.name].dt.tz is None:
            whole[field.name] = whole[field.name].dt.tz_localize(zone)
    return pa.Table.from_pandas(whole, schema, preserve_index=False, safe=False)


def _each_key(sides: list[DataFrame], keyed: list[DataFrame], function: Callable[..., Frame], schema: str) -> DataFrame:
    """``function`` over the rows of every key in one or two tables.

    Partitions are sorted by key, so a task reads them batch by batch and holds the rows of a batch and of the
    key that goes on into the next; it hands pandas all keys of a batch at once and cuts them there.
    """
    spark = sides[0].sparkSession
    zone = spark.conf.get("spark.sql.session.timeZone")
    wanted = StructType.fromDDL(schema)
    out = to_arrow_schema(wanted)
    names = [[f"c{s}_{i}" for i in range(len(side.columns))] for s, side in enumerate(sides)]
    rows = []
    for s, frame in enumerate(keyed):
        cells = [F.lit(None).cast(f.dataType).alias(n) if t != s else col(f.name).alias(n) for t, side in enumerate(sides) for f, n in zip(side.schema.fields, names[t], strict=True)]
        rows.append(frame.select("__key", F.lit(s).alias("__side"), *cells))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes with much code are not put in one task
    placed = functools.reduce(DataFrame.union, rows).repartition(tasks, "__key").sortWithinPartitions("__key", "__side")
    labels = [side.columns for side in sides]

    def called(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table["__key"].combine_chunks().dictionary_encode()
        code = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).indices.to_numpy(zero_copy_only=False)
        side = table["__side"].to_numpy()
        parts = []
        for s in range(len(labels)):
            mine = table.filter(pa.array(side == s)).select(names[s])
            kinds = [(labels[s][i], str(t.to_pandas_dtype().__name__)) for i, t in enumerate(mine.schema.types) if pa.types.is_integer(t) and mine.column(i).null_count]
            frame = _as_user_sees(mine.rename_columns([f"_{i}" for i in range(len(labels[s]))]), zone).set_axis(labels[s], axis=1)
            parts.append((frame, kinds, np.searchsorted(code[side == s], np.arange(code[-1] + 2))))
        found = [function(*[_typed(f.iloc[at[k] : at[k + 1]], kinds) for f, kinds, at in parts]) for k in range(int(code[-1]) + 1)]
        yield from _as_arrow(found, out, zone).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch.column("__key")[-1]
            goes_on = int(pa.compute.sum(pa.compute.equal(batch.column("__key"), last)).as_py())  # rows of the last key
            if goes_on < len(batch):
                yield from called(pa.Table.from_batches([*held, batch.slice(0, len(batch) - goes_on)]))
                held = []
            elif held and held[-1].column("__key")[-1] != last:
                yield from called(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(len(batch) - goes_on))
        if held:
            yield from called(pa.Table.from_batches(held))

    return placed.mapInArrow(run, wanted)


def apply_grouped(df: DataFrame, keys: Sequence[str], function: Callable[[Frame], Frame], schema: str) -> DataFrame:
    """``function`` sees all rows of one key at once, so every key has to fit in a task.  A missing key is a key.

    Where one key may hold a large part of the table, use :func:`apply_combined`.
    """
    require_columns(df, keys)
    return _each_key([df], [df.withColumn("__key", _key(keys))], function, schema)


def apply_cogrouped(
    left: DataFrame, right: DataFrame, keys: Sequence[str], function: Callable[[Frame, Frame], Frame], schema: str, split: str | None = None
) -> DataFrame:
    """``function`` sees the rows of one key in two tables, one of them perhaps empty; more tables are a chain of such steps.

    Every key has to fit in a task on both sides, unless ``split`` names a side, ``left`` or ``right``, whose
    rows the function may see in parts (each with all rows of the other side): keys with over ``CHUNK`` rows
    there are cut, and the other side's rows of those keys go with each part.  A hot side that cannot be
    split is shrunk first, by :func:`apply_combined` or an aggregation.
    """
    require_columns(left, keys)
    require_columns(right, keys)
    if split not in (None, "left", "right"):
        raise ValueError(f"Unsupported side: {split}. Supported: left, right.")
    keyed = {"left": left.withColumn("__key", _key(keys)), "right": right.withColumn("__key", _key(keys))}
    if split:
        other = "right" if split == "left" else "left"
        many = keyed[split].groupBy(F.col("__key").alias("__hot")).count().where(F.col("count") > CHUNK)
        many = many.select("__hot", F.ceil(F.col("count") / CHUNK).alias("__parts"))
        joined = {s: f.join(many, f["__key"] == many["__hot"], "left") for s, f in keyed.items()}
        part = F.pmod(F.xxhash64(*[col(c) for c in (left if split == "left" else right).columns]), F.col("__parts"))
        parts = F.explode(F.when(F.col("__parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
        name = F.concat(F.col("__key"), F.lit("#"), F.coalesce("__part", F.lit(0)).cast("string"))
        keyed = {split: joined[split].withColumn("__part", part).withColumn("__key", name), other: joined[other].withColumn("__part", parts).withColumn("__key", name)}
    return _each_key([left, right], [keyed["left"], keyed["right"]], function, schema)


def apply_combined(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[Frame], Frame],
    partial_schema: str,
    merge: Callable[[Frame], Frame],
    schema: str,
    combine: Callable[[Frame], Frame] | None = None,
    spread: int = 64,
) -> DataFrame:
    """Steps for hot keys: ``partial`` shrinks each batch, ``merge`` joins the partial rows of a key.

    ``partial`` must keep the key columns.  ``combine`` turns partial rows of many keys into fewer partial
    rows; with it a task hands on the rows of one call, not of one call a batch, and the rows of a key are
    combined in ``spread`` tasks before the last one, which then sees ``spread`` partial results at most.
    """
    require_columns(df, keys)
    if combine is None:
        return apply_grouped(apply_batches(df, partial, partial_schema), keys, merge, schema)

    def shrink(rows: Iterator[Frame], first: Callable[[Frame], Frame]) -> Iterator[Frame]:
        kept = None
        for batch in rows:
            small = first(batch)
            kept = small if kept is None else combine(pd.concat([kept, small], ignore_index=True))
        if kept is not None:
            yield kept

    shrunk = df.mapInPandas(lambda rows: shrink(rows, partial), partial_schema)
    salted = shrunk.repartition(*[col(k) for k in keys], F.pmod(F.spark_partition_id(), F.lit(spread)))
    return apply_grouped(salted.mapInPandas(lambda rows: shrink(rows, combine), partial_schema), keys, merge, schema)


USER_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "batches": apply_batches,
    "grouped": apply_grouped,
    "cogrouped": apply_cogrouped,
    "combined": apply_combined,
}


def user_function(df: DataFrame, kind: str = "batches", **arguments) -> DataFrame:
    """One of the forms above by name; ``cogrouped`` takes the second table as ``right``."""
    if kind not in USER_FUNCTIONS:
        raise ValueError(f"Unsupported form: {kind}. Supported: {sorted(USER_FUNCTIONS)}.")
    return USER_FUNCTIONS[kind](df, **arguments)
