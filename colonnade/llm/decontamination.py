"""Documents that hold benchmark passages, by the q-gram lemma and banded alignment.

A passage of m characters that a document holds with at most e edits shares at least m + 1 - q - q*e of
its q-grams with it, on diagonals at most e apart.  Shared q-grams are counted in diagonal bands of width
2(e + 1), each overlapping the next by half, so that some band holds them all; bands below the bound are
dropped and the others are aligned, all candidates of a task in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.arrays import _tables, joined, mixed, slices, text_bytes
from colonnade.llm.characters import END, folded_texts
from colonnade.llm.tables import filled, table

Q = 8
#: Edits allowed for each character of a passage.
EDITS = 0.1
#: Characters of passages in one broadcast index; more passages make more indexes, each applied to all documents.
INDEXED = 4_000_000
#: Characters whose q-grams are looked up at a time, and cells of the alignments done in step.
STRIDE = 1 << 20
CELLS = 1 << 19

_FILTER_BITS = 22
_FAR = 1 << 30
#: Bits of an alignment's cell that hold the start column.
_BITS = 24


class PassageIndex:
    """The q-grams of a bounded set of passages."""

    def __init__(self, items: list[tuple[object, str]], q: int, edits: float):
        self.q = q
        self.ids, texts = [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode() + b"\0", np.uint8)
            low, _, begin, _ = folded_texts(raw, np.array([0, len(raw)]))
            body = low[: begin[1] - 1]
            body = body[:-1] if len(body) and body[-1] == 32 else body
            if len(body) >= q:
                self.ids.append(item_id)
                texts.append(body)
        self.length = np.array([len(t) for t in texts], np.int64)
        # no more edits than leave one shared q-gram, which the lemma needs
        self.edits = np.minimum((self.length * edits).astype(np.int64), (self.length - q) // q)
        self.need = self.length + 1 - q - q * self.edits
        self.at = np.concatenate(([0], np.cumsum(self.length)))
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        grams, item, offset = [], [], []
        for k, t in enumerate(texts):
            grams.append(gram_hashes(t, q))
            item.append(np.full(len(grams[-1]), k))
            offset.append(np.arange(len(grams[-1])))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.offset = np.concatenate(offset)[order] if item else np.zeros(0, np.int64)
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(order)))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams of code points."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
    return mixed((total[q:] - total[:n]) * inverse[:n])


def _bands(points: np.ndarray, begin: np.ndarray, index: PassageIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, passage and first diagonal of the bands that reach the bound."""
    found = []
    for low in range(0, max(0, len(points) - index.q + 1), STRIDE):
        h = gram_hashes(points[low : low + STRIDE + index.q - 1], index.q)
        spot = np.flatnonzero(index.seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        rank = np.minimum(np.searchsorted(index.grams, h[spot]), len(index.grams) - 1)
        real = index.grams[rank] == h[spot]
        spot, rank = spot[real] + low, rank[real]
        many = index.many[rank]
        total = int(many.sum())
        posting = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(index.first[rank], many)
        item = index.item[posting]
        at = np.repeat(spot, many)
        text = np.searchsorted(begin, at, side="right") - 1
        width = index.edits[item] + 1
        band = (at - begin[text] - index.offset[posting] + index.length[item]) // width + 1  # over 0
        key = (text * len(index.ids) + item) << 32 | band
        for shifted in (key, key - 1):  # band b holds diagonals from (b - 1) * width on, two widths of them
            found.append(np.unique(shifted, return_counts=True))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([c for _, c in found]), minlength=len(keys))
    item = (keys >> 32) % len(index.ids)
    keys, item = keys[count >= index.need[item]], item[count >= index.need[item]]
    return (keys >> 32) // len(index.ids), item, ((keys & 0xFFFFFFFF) - 1) * (index.edits[item] + 1) - index.length[item]


def _aligned(points: np.ndarray, begin: np.ndarray, index: PassageIndex, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, passage, start, end and edits of the candidates that stay within the edit budget."""
    order = np.argsort(index.length[item], kind="stable")
    at = 0
    while at < len(order):
        own = order[at:]
        # the band, the edits around it, and the places it comes by
        width = 4 * (index.edits[item[own]] + 1) + 1 + index.length[item[own]]
        own = own[: max(1, int(np.searchsorted(np.maximum.accumulate(width) * np.arange(1, len(own) + 1), CELLS, side="right")))]
        at += len(own)
        t, k = text[own], item[own]
        slack = index.edits[k] + 1
        w = int((4 * slack + 1).max())
        left = begin[t] + diagonal[own] - slack  # text place before the first character, at step 0
        column = np.arange(w)
        outside = column >= (4 * slack + 1)[:, None]
        # all places that the band comes by: step i looks at columns i to i + w
        longest = int(index.length[k].max())
        place = left[:, None] + np.arange(w + longest)
        beyond = (place < begin[t][:, None]) | (place > (begin[t + 1] - 1)[:, None])
        symbols = points[np.clip(place, 0, len(points) - 1)]
        # edits in the high bits, the start column in the low ones: least edits first, then the earliest start
        cell = np.where(outside | beyond[:, :w], _FAR << _BITS, column)
        step = (column << _BITS).astype(np.int64)
        result = np.full(len(own), _FAR << _BITS, np.int64)
        end = np.zeros(len(own), np.int64)
        done = 0  # candidates come by rising length: those before are at their end
        for i in range(longest):
            symbol = index.text[index.at[k[done:]] + i]
            new = cell + np.multiply(symbols[done:, i : i + w] != symbol[:, None], 1 << _BITS, dtype=np.int64)  # no symbol is END
            np.minimum(new[:, :-1], cell[:, 1:] + (1 << _BITS), out=new[:, :-1])
            bad = outside[done:] | beyond[done:, i + 1 : i + 1 + w]
            np.copyto(new, _FAR << _BITS, where=bad)
            new -= step
            cell = np.minimum.accumulate(new, axis=1)
            cell += step
            np.copyto(cell, _FAR << _BITS, where=bad)
            n = int(np.searchsorted(index.length[k[done:]], i + 1, side="right"))
            if n:
                best = np.argmin(cell[:n], axis=1)
                result[done : done + n] = cell[np.arange(n), best]
                end[done : done + n] = place[np.arange(done, done + n), best + i + 1]
                done, cell = done + n, cell[n:]
        edits = result >> _BITS
        good = np.flatnonzero(edits <= index.edits[k])
        start = left + (result & ((1 << _BITS) - 1))
        yield t[good], k[good], start[good] - begin[t[good]], end[good] - begin[t[good]], edits[good]


def passages_in(data: np.ndarray, at: np.ndarray, first: int, last: int, index: PassageIndex) -> list[tuple[int, object, int, int, int]]:
    """Row, passage, start, end (code points of the text) and edits of every match in the texts of some rows."""
    if not len(index.grams):
        return []
    buffer, start = joined(data, at, first, last, fill=END)
    points, place, begin, raw = folded_texts(buffer, start)
    out: dict[tuple[int, int, int], tuple[int, int]] = {}
    for t, k, s, e, edits in _aligned(points, begin, index, *_bands(points, begin, index)):
        for row in zip(t.tolist(), k.tolist(), s.tolist(), e.tolist(), edits.tolist(), strict=True):
            spot = (row[0], row[1], row[2])
            out[spot] = min(out.get(spot, (_FAR, 0)), (row[4], row[3]))
    return [
        (first + t, index.ids[k], int(place[begin[t] + s] - raw[t]), int(place[begin[t] + e - 1] + 1 - raw[t]), edits)
        for (t, k, s), (edits, e) in sorted(out.items())
        if e > s
    ]


def _indexes(benchmark: DataFrame, item: str, item_text: str, q: int, edits: float) -> list:
    """Broadcast indexes of all passages, each of about ``INDEXED`` characters."""
    spark = benchmark.sparkSession
    passages = benchmark.select(F.col(item).alias("item"), filled(item_text).alias("passage"))
    n = max(1, -(-(passages.agg(F.sum(F.length("passage"))).first()[0] or 0) // INDEXED))
    part = F.pmod(F.xxhash64("item", "passage"), F.lit(n))
    return [spark.sparkContext.broadcast(PassageIndex([tuple(r) for r in passages.where(part == k).collect()], q, edits)) for k in range(n)]


def without_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", q: int = Q, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs``, as they are, that hold no passage (see ``contaminated``); one pass for each index."""
    for index in _indexes(benchmark, item, item_text, q, edits):

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = text_bytes(batch.column(text).fill_null(""))
                held = np.zeros(len(batch), bool)
                for first, last in slices(at):
                    held[[row for row, *_ in passages_in(data, at, first, last, index.value)]] = True
                yield batch.filter(pa.array(~held))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", q: int = Q, edits: float = EDITS
) -> DataFrame:
    """Every document with the benchmark passages it holds.

    Texts and passages are compared in lower case, with each run of characters that are no letters or
    digits as one blank.  A passage of m characters matches a stretch of a text at most ``edits`` * m edits
    away (fewer for short passages: the lemma must leave one shared q-gram); passages shorter than ``q``
    characters are not looked for.  Null texts are empty; a null doc_id and repeated rows are kept.

    Returns doc_id, contaminated, n_passages (distinct) and matches (item, start, stop in characters, edits).
    """
    kind = dict(benchmark.dtypes)[item]
    rows = docs.select("doc_id", filled(text).alias("_text")).withColumn("_copy", F.xxhash64("_text"))
    match = f"array<struct<item:{kind},start:int,stop:int,edits:int>>"
    hits = None
    for index in _indexes(benchmark, item, item_text, q, edits):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = text_bytes(batch.column("_text"))
                for first, last in slices(at):
                    found: dict[int, list] = {}
                    for row, *rest in passages_in(data, at, first, last, index.value):
                        found.setdefault(row, []).append(dict(zip(("item", "start", "stop", "edits"), rest, strict=True)))
                    if found:
                        own = pa.array(list(found), pa.int64())
                        value = pa.struct([("item", _arrow(kind)), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())])
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": batch.column("doc_id").take(own), "_copy": batch.column("_copy").take(own), "matches": pa.array(list(found.values()), pa.list_(value))}
                        )

        part = rows.mapInArrow(search, f"doc_id {dict(docs.dtypes)['doc_id']}, _copy long, matches {match}")
        hits = part if hits is None else hits.union(part)
    # repeated rows were searched once each: take any of their equal answers from each index
    hits = hits.select("doc_id", "_copy", F.explode("matches").alias("m")).groupBy("doc_id", "_copy").agg(F.array_sort(F.collect_set("m")).alias("matches"))
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d._copy") == F.col("h._copy"))
    matches = F.coalesce("h.matches", F.array().cast(match))
    return (
        rows.select("doc_id", "_copy")
        .alias("d")
        .join(hits.alias("h"), same, "left")
        .select(
            "d.doc_id",
            (F.size(matches) > 0).alias("contaminated"),
            F.size(F.array_distinct(F.transform(matches, lambda m: m["item"]))).cast("long").alias("n_passages"),
            matches.alias("matches"),
        )
    )


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())


def op2_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage; documents without one have no row."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")
