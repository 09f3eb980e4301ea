"""Records of delimited text whose quoted cells may hold line breaks, read by many tasks a file.

A line ends a record if the quotes up to its end are even in number.  So tasks count the quotes of each
block of a file, a running sum over the blocks tells with which parity a block starts, and each block is cut
into records by itself.  What is left are the pieces of records that cross block borders, at most two a block;
they are put together in a step of their own.

Quotes are taken to enclose cells, and to be doubled inside them; lines end with LF or CRLF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of pieces: a whole record, and the end, the middle and the beginning of one that crosses block borders.
_WHOLE, _END, _MIDDLE, _BEGIN = range(4)
_SCHEMA = "file string, block long, kind int, head boolean, value string"
_BLANK = " \t\r\n"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Every line with its file, the start of its block, its place, and the quotes it holds."""
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        value.alias("value"),
    ).withColumn("quotes", F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'))))


class _Block:
    """The records of one block, line by line; what is open at the end is a piece."""

    def __init__(self, file: str, block: int, odd: bool):
        self.file, self.block, self.odd = file, block, odd
        self.open: list[str] = []
        self.kind = _END if odd else _WHOLE
        self.header = block == 0

    def _row(self, kind: int, value: str) -> tuple:
        head = self.header and kind in (_WHOLE, _BEGIN) and bool(value.strip(_BLANK))
        if head:
            self.header, value = False, value.removeprefix("﻿")
        return self.file, self.block, kind, head, value if kind in (_MIDDLE, _BEGIN) else value.removesuffix("\r")

    def add(self, lines: list[str], quotes: np.ndarray) -> Iterator[tuple]:
        odd = (np.cumsum(quotes) + self.odd) % 2 == 1
        first = 0
        for last in np.flatnonzero(~odd).tolist():
            yield self._row(self.kind, "\n".join([*self.open, *lines[first : last + 1]]) if self.open or last > first else lines[last])
            self.open, self.kind, first = [], _WHOLE, last + 1
        self.open += lines[first:]
        self.odd = bool(odd[-1])

    def rest(self) -> Iterator[tuple]:
        if self.open:
            yield self._row(_MIDDLE if self.kind == _END else _BEGIN, "\n".join(self.open))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lines of a task, which come block by block and in order."""
    now: _Block | None = None
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))], ["file", "block", "kind", "head", "value"])
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        file = batch.column("file").dictionary_encode()
        code = file.indices.to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (code[1:] != code[:-1]))))
        lines, quotes, rows = batch.column("value").to_pylist(), batch.column("quotes").to_numpy(zero_copy_only=False), []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(batch)], strict=True):
            key = (file.dictionary[int(code[a])].as_py(), int(block[a]))
            if now is None or (now.file, now.block) != key:
                rows += now.rest() if now else ()
                now = _Block(*key, batch.column("odd")[a].as_py())
            rows += now.add(lines[a:b], quotes[a:b])
        yield table(rows)
    if now:
        yield table(list(now.rest()))


def records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """value and head of every record of the files in ``path``; ``head`` marks the first record of each file.

    Blank records between others are left out, as a record whose quote is never closed lasts to the end of
    its file.  A file of any size is read by as many tasks as it has blocks, and one record has to fit in memory.
    """
    lines = _lines(spark, path, encoding)
    counted = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # joined by hash of a broadcast table or by sorting, a block's lines are in one task; the sort puts them in order
    placed = lines.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "place")
    pieces = placed.mapInArrow(_cut, _SCHEMA)
    crossing = pieces.where(F.col("kind") != _WHOLE)
    so_far = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = crossing.withColumn("record", F.count_if(F.col("kind") == _BEGIN).over(so_far))
    joined = numbered.groupBy("file", "record").agg(
        F.max("head").alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "value"))), lambda p: p["value"]), "\n").alias("value")
    )
    every = pieces.where(F.col("kind") == _WHOLE).select("value", "head").union(joined.select("value", "head"))
    return every.where(F.col("value").rlike(r"[^ \t\r\n]"))
