"""Conflict-constrained best-fit packing of documents into training sequences.

A sequence of fixed capacity holds at most one piece of a source and one of a duplicate cluster.  Open
sequences are kept in the order of their residual room with one bitmap of the sources and one of the
clusters in them.  A piece, largest first, starts at the tightest sequence that has room and moves on to
the successor until one has neither its source nor its cluster; if none has, it opens a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.arrays import joined, mixed, range_hashes, slices, text_bytes, word_ranges
from colonnade.llm.tables import filled, table

#: Tokens of a sequence.  A token is a word, and one more ends each document.
CAPACITY = 2048
#: Documents packed together in one task, whatever their source; the last sequences of a group may stay open.
GROUP = 10_000

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def word_counts(data: np.ndarray, at: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts in some rows: words, and a hash of the words in lower case (A-Z)."""
    buffer, begin = joined(data, at, first, last)
    buffer = _UPPER[buffer]
    starts, ends, _ = word_ranges(buffer)
    count = np.diff(np.searchsorted(starts, begin))
    h = range_hashes(buffer, starts, ends)
    bound = np.concatenate(([0], np.cumsum(count)))
    place = (np.arange(len(h)) - np.repeat(bound[:-1], count)).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h + mixed(place + np.uint64(1))), dtype=np.uint64)))
    return count, (total[bound[1:]] - total[bound[:-1]]).view(np.int64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column("_text"))
        for first, last in slices(at):
            count, words = word_counts(data, at, first, last)
            own = batch.slice(first, last - first)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": own.column("doc_id"), "_source": own.column("_source"), "_tokens": pa.array(count + 1), "_words": pa.array(words)}
            )


def _conflicts(values: np.ndarray) -> np.ndarray:
    """Numbers of the values that occur twice or more; -1 for the others, which cannot conflict."""
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    return number[inverse]


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, taken in the order given; -1 in ``source`` or ``cluster`` is free of conflicts."""
    n = len(size)
    words = [int(v.max(initial=-1)) // 64 + 1 for v in (source, cluster)]
    marks = [np.zeros((n, max(1, w)), np.uint64) for w in words]
    kinds = [(v // 64, np.uint64(1) << (np.maximum(v, 0) % 64).astype(np.uint64), v >= 0) for v in (source, cluster)]
    room = np.empty(n, np.int64)  # residual << 32 | sequence, ascending
    open_, made = 0, 0
    out, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(n):
        need = int(size[k])
        at, step, chosen = int(np.searchsorted(room[:open_], need << 32)), 16, -1
        while at < open_:
            some = room[at : at + step] if at + step <= open_ else room[at:open_]
            ids = some & 0xFFFFFFFF
            taken = np.zeros(len(ids), np.uint64)
            for mark, (word, bit, used) in zip(marks, kinds, strict=True):
                if used[k]:
                    taken |= mark[ids, word[k]] & bit[k]
            free = np.flatnonzero(taken == 0)
            if len(free):
                chosen = at + int(free[0])
                break
            at, step = at + step, min(2 * step, 4096)
        if chosen < 0:
            sequence, left = made, capacity
            made += 1
        else:
            sequence, left = int(room[chosen]) & 0xFFFFFFFF, int(room[chosen]) >> 32
            room[chosen : open_ - 1] = room[chosen + 1 : open_].copy()
            open_ -= 1
        out[k], offset[k] = sequence, capacity - left
        for mark, (word, bit, used) in zip(marks, kinds, strict=True):
            if used[k]:
                mark[sequence, word[k]] |= bit[k]
        left -= need
        if left:
            value = left << 32 | sequence
            spot = int(np.searchsorted(room[:open_], value))
            room[spot + 1 : open_ + 1] = room[spot:open_].copy()
            room[spot] = value
            open_ += 1
    return out, offset


def _packed(capacity: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("_tokens", "descending"), ("doc_id", "ascending"), ("_words", "ascending"), ("_cluster", "ascending")])
        tokens = group["_tokens"].to_numpy()
        whole, rest = tokens // capacity, tokens % capacity
        source = group["_source"].combine_chunks().dictionary_encode()
        source = source.chunk(0) if isinstance(source, pa.ChunkedArray) else source
        code = source.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.where(code < 0, -1 - np.arange(len(code)), code)  # no source: unlike all others
        some = np.flatnonzero(rest)
        some = some[np.argsort(-rest[some], kind="stable")]
        sequence, offset = best_fit(rest[some], _conflicts(code[some]), _conflicts(group["_cluster"].to_numpy()[some]), capacity)
        full = np.repeat(np.arange(len(tokens)), whole)
        piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        made = int(sequence.max(initial=-1)) + 1
        row = np.concatenate((full, some))
        number = np.concatenate((made + np.arange(len(full)), sequence))
        return pa.table(
            {
                "doc_id": group["doc_id"].take(pa.array(row)),
                "piece": pa.array(np.concatenate((piece, whole[some])).astype(np.int32)),
                "first_token": pa.array(np.concatenate((piece * capacity, whole[some] * capacity))),
                "n_tokens": pa.array(np.concatenate((np.full(len(full), capacity), rest[some]))),
                "sequence": pa.array(key[0].as_py() << 32 | number),
                "offset": pa.array(np.concatenate((np.zeros(len(full), np.int64), offset))),
            }
        )

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """Where every document goes: one row a piece.

    A document of more than ``capacity`` tokens is cut into full pieces, which fill a sequence each, and a
    rest.  ``cluster`` names a column of duplicate clusters; without one, texts of the same words in lower
    case (A-Z) are a cluster.  A null source conflicts with none.  A null or empty text is one token, its
    end; null ids and repeated rows are packed like others.

    Documents are dealt by a hash into groups of about ``GROUP``, however hot a source or cluster is.
    Returns doc_id, piece, first_token, n_tokens, sequence, offset.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col(source).cast("string").alias("_source"), filled(text).alias("_text"), *([F.xxhash64(cluster).alias("_given")] if cluster else []))
    if cluster:
        words = F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")) + 1
        rows = rows.select("doc_id", "_source", words.cast("long").alias("_tokens"), F.xxhash64("_text").alias("_words"), F.col("_given").alias("_cluster"))
    else:
        rows = rows.mapInArrow(_measured, f"doc_id {kind}, _source string, _tokens long, _words long").withColumn("_cluster", F.col("_words"))
    groups = max(1, -(-docs.count() // GROUP))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "_words"), F.lit(groups)))
    schema = f"doc_id {kind}, piece int, first_token long, n_tokens long, sequence long, offset long"
    return rows.groupBy("_group").applyInArrow(_packed(capacity), schema)


def op8_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
