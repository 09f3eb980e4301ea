"""Near-duplicates by SimHash, linked through a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in at most four bits agree in at least four byte positions.
The index therefore lists every fingerprint under each choice of four positions and the bytes there; two
fingerprints meet in a posting list exactly if they reach the guaranteed minimum.  In a list, the shared
positional bytes of a pair are tallied, the pair is taken up in the first list that the tally names and
skipped in the others, and what remains is verified by counting differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.arrays import mixed, text_bytes
from colonnade.llm.components import component_roots
from colonnade.llm.tables import cut, filled, parts, table

WORDS = 4
BITS = 4
SEED = 42
#: Index entries in one part, and the longest posting list whose members are compared with each other.
ENTRIES = 400_000
LONG_LIST = 2048

_POSITIONS = list(combinations(range(8), 8 - BITS))
#: The bits that a list's key is made of.
_MASKS = np.array([sum(0xFF << 8 * p for p in c) for c in _POSITIONS], np.uint64)
#: For every set of agreeing positions, the first list in which the pair meets.
_FIRST = np.array([next((k for k, c in enumerate(_POSITIONS) if all(s >> p & 1 for p in c)), -1) for s in range(256)])
_PIECE = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of the word shingles of a text."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1)[: len(found) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + _PIECE], ends[k : k + _PIECE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column("_text"))
        whole = memoryview(data)
        prints = np.fromiter((fingerprint(bytes(whole[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, len(at) - 1)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "copy": batch.column("copy"), "fp": pa.array(prints.view(np.int64))})


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, copy (a hash of the text) and fp, the fingerprint as a signed long, of every row."""
    rows = docs.select("doc_id", F.xxhash64(filled(text)).alias("copy"), filled(text).alias("_text"))
    return rows.mapInArrow(_fingerprinted, f"doc_id {dict(docs.dtypes)['doc_id']}, copy long, fp long")


def _indexed(lists: int):
    """Index entries of the fingerprints, packed by part: each part's keys and fingerprints as one row."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for piece in range(0, len(whole), 8192):
                fp = whole[piece : piece + 8192]
                which = np.repeat(np.arange(len(_POSITIONS), dtype=np.uint64), len(fp))
                prints = np.tile(fp, len(_POSITIONS))
                key = mixed((prints & _MASKS[which.astype(np.int64)]) * np.uint64(len(_POSITIONS)) + which)
                part = (key >> np.uint64(20)) % np.uint64(lists)
                order = np.argsort(part)
                bound = np.flatnonzero(np.diff(part[order], prepend=lists + 1, append=lists + 1))
                blob = np.empty(len(order), [("which", np.uint8), ("fp", np.uint64)])
                blob["which"], blob["fp"] = which[order], prints[order]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(part[order][bound[:-1]].astype(np.int64)),
                        "entries": pa.array([blob[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.binary()),
                    }
                )

    return index


class _Sets:
    """Union-find over places of an array; ``label`` is flat after each round of unions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _near(x: np.ndarray, y: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Pairs of a posting list that link, each in the first list where it meets."""
    differ = x ^ y
    agree = np.packbits(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
    return (_FIRST[agree] == which) & (np.bitwise_count(differ) <= BITS)


def _long_list(fp: np.ndarray, mask: np.uint64, sets: _Sets, base: int) -> None:
    """Link the members of a long list in time linear in its length.

    Fingerprints at most four bits apart are both at most two bits from one midpoint, and outside the
    list's own bytes there are 32 bits, so 529 midpoints a member find every link; a midpoint's members are
    up to four bits apart, so each is a link.
    """
    bit = [np.uint64(1 << k) for k in range(64) if not int(mask) >> k & 1]
    flips = np.array([0, *bit, *(a | b for a, b in combinations(bit, 2))], np.uint64)
    rounds = -(-len(fp) * len(flips) // 4_000_000)
    for r in range(rounds):
        middles, owners = [], []
        for f in flips:
            middle = fp ^ f
            own = np.flatnonzero(mixed(middle) % np.uint64(rounds) == r)
            middles.append(middle[own])
            owners.append(own)
        middle, owner = np.concatenate(middles), np.concatenate(owners)
        order = np.argsort(middle)
        middle, owner = middle[order], owner[order]
        same = np.flatnonzero(middle[1:] == middle[:-1])
        sets.unite(base + owner[same], base + owner[same + 1])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one part, at most one fewer than the members of each component of a posting list."""
    entries = np.concatenate([np.frombuffer(e.as_py(), [("which", np.uint8), ("fp", np.uint64)]) for b in batches for e in b.column("entries")])
    which, fp = entries["which"], entries["fp"]
    key = fp & _MASKS[which]
    order = np.lexsort((fp, key, which))
    which, fp, key = which[order], fp[order], key[order]
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (which[1:] != which[:-1]))))
    size = np.diff(np.append(starts, len(fp)))
    sets = _Sets(len(fp))
    for k in np.flatnonzero(size > LONG_LIST):
        _long_list(fp[starts[k] : starts[k] + size[k]], _MASKS[which[starts[k]]], sets, int(starts[k]))
    left = np.repeat(np.where(size > LONG_LIST, 0, size), size) - (np.arange(len(fp)) - np.repeat(starts, size))  # members from here on
    at, step = np.flatnonzero(left > 1), 1
    while len(at):
        near = at[_near(fp[at], fp[at + step], which[at])]
        sets.unite(near, near + step)
        step += 1
        at = at[left[at] > step]
    member = np.flatnonzero(sets.label != np.arange(len(fp)))
    yield pa.RecordBatch.from_pydict({"a": pa.array(fp[member].view(np.int64)), "b": pa.array(fp[sets.label[member]].view(np.int64))})


def near_links(prints: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column ``fp``, that connect all within four bits; ``n`` rows."""
    lists = parts(prints.sparkSession, n * len(_POSITIONS), ENTRIES)
    indexed = prints.select("fp").mapInArrow(_indexed(lists), "part long, entries binary")
    return indexed.groupBy("part").applyInArrow(_linked, "a long, b long")


_LAST = 2**63 - 1  # stands for a null doc_id: later than all others


def _rooted(rows: DataFrame) -> DataFrame:
    """fp, root, least (doc_id) and first (id and copy of the first document) of every distinct fingerprint."""
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), "copy")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(place).alias("first")))
    roots = component_roots(near_links(nodes, nodes.count()))
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, copy, fp, root and component_id of every document; ``root`` is a fingerprint of the component.

    Documents with equal fingerprints are one node, whatever their number.  A component's id is its
    smallest doc_id; null ids count only where there is no other, and then it is null.  A null text is an
    empty one, with fingerprint zero; repeated rows share a node.
    """
    rows = cut(fingerprints(docs, text))  # a few bytes a document, read three times
    rooted = _rooted(rows)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "copy", "fp", "root", "component_id")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch without those whose id and copy came before in it, so that one repeated row is no hot key."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_copy")], axis=1)
        first = np.unique(keys, axis=0, return_index=True)[1]
        yield batch if len(first) == len(batch) else batch.take(pa.array(np.sort(first)))


def one_of_each_component(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component of ``simhash_components``: the one with the smallest doc_id.

    Rows with a null doc_id come after all others; of those, and of rows with one doc_id but different
    texts, the text with the smallest hash stays.  Of repeated rows one stays; where they differ in other
    columns, any of them.  All columns stay as they are, whatever their names.
    """
    rows = cut(fingerprints(docs, text))
    first = _rooted(rows).groupBy("root").agg(F.min("first").alias("first"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64(filled(text)).alias("_copy"), whole)
    once = keyed.mapInArrow(_once, keyed.schema)
    chosen = once.join(first.select(F.col("first.id").alias("_id"), F.col("first.copy").alias("_copy")), ["_id", "_copy"], "left_semi")
    return chosen.dropDuplicates(["_id", "_copy"]).select(*(F.col(f"_row.`{c}`") for c in docs.columns))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
