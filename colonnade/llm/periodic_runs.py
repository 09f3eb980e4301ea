"""Periodic runs of words in every text, by uniting suffix classes in falling order of their common prefixes.

A run is a stretch of words with smallest period q that no neighbouring word extends.  For its first word i
the suffixes at i and i + q share exactly the rest of the run, and no suffix between them shares as much.
So, as in Kruskal's algorithm, neighbours in suffix order are united by decreasing common prefix; a class
keeps its places in order, and two places that become neighbours in a united class, at a distance within
the common prefix, seed a run.  The first seed with a period and an end is the run's start.

Only suffixes that share as many words as the shortest wanted run needs are ordered and united; the others
can seed nothing.  Suffixes are ordered by prefix doubling over all texts of a slice at once.  Words are
compared by 64-bit hash first; every run found is checked word by word, and a text whose check fails is
done again with exact word numbers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.arrays import joined, mixed, range_hashes, slices, text_bytes, word_ranges
from colonnade.llm.tables import filled, table

#: Words that a run has at least, and how many times its period.
LEAST = 6
TIMES = 4
#: Places in one piece of an ordered set.
_PIECE = 2048


class _Places:
    """Places in ascending order, in pieces of bounded length."""

    __slots__ = ("pieces", "firsts", "n")

    def __init__(self, place: int):
        self.pieces, self.firsts, self.n = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, place: int) -> tuple[int, int]:
        """Put a place in; its neighbours before and after, -1 where there is none."""
        at = max(0, bisect_left(self.firsts, place) - 1) if len(self.firsts) > 1 else 0
        piece = self.pieces[at]
        i = bisect_left(piece, place)
        if i:
            before = piece[i - 1]
        else:
            before = self.pieces[at - 1][-1] if at else -1
        if i < len(piece):
            after = piece[i]
        else:
            after = self.firsts[at + 1] if at + 1 < len(self.firsts) else -1
        piece.insert(i, place)
        if not i:
            self.firsts[at] = place
        if len(piece) > _PIECE:
            half = len(piece) // 2
            self.pieces[at : at + 1] = [piece[:half], piece[half:]]
            self.firsts.insert(at + 1, piece[half])
        self.n += 1
        return before, after


def _neighbours(words: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``shallow`` words or more, and how many they share.

    ``words`` are dense numbers; each text ends with a number of its own, so no two suffixes share an end.
    """
    none = np.zeros(0, np.int64)
    n = len(words)
    padded = np.concatenate((words, np.full(shallow, -1, words.dtype)))
    window = np.zeros(n, np.uint64)
    for j in range(shallow):
        window = window * np.uint64(0xD6E8FEB86659FD93) + mixed(padded[j : j + n].astype(np.uint64))
    ranked = np.sort(window)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return none, none, none
    spot = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
    alive = np.flatnonzero(twice[spot] == window)
    place = np.unique(np.concatenate((alive, np.minimum(alive + shallow, n - 1))))  # suffixes, and what follows their first words
    number = np.full(n + 1, -1, np.int32)
    number[place] = np.arange(len(place), dtype=np.int32)

    columns = [padded[place + j] for j in range(shallow)]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(place), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    start = np.flatnonzero(new)
    rank = np.empty(len(place), np.int32)  # where a suffix's class starts in the order
    rank[order] = np.repeat(start, np.diff(np.append(start, len(place))))
    levels, width = [rank], shallow
    while True:
        size = np.bincount(rank, minlength=len(place))
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        after = rank[number[place[tied] + width]]
        by = np.lexsort((after, rank[tied]))
        tied, after = tied[by], after[by]
        own = rank[tied]
        heads = np.concatenate(([True], own[1:] != own[:-1]))
        inner = heads | np.concatenate(([True], after[1:] != after[:-1]))
        at = np.arange(len(tied))
        rank = rank.copy()
        rank[tied] = own + at[inner][np.cumsum(inner) - 1] - at[heads][np.cumsum(heads) - 1]
        levels.append(rank)
        width *= 2
    final = np.argsort(rank)
    same = np.flatnonzero(levels[0][final[1:]] == levels[0][final[:-1]])
    left, right = place[final[same]], place[final[same + 1]]
    a, b = left.copy(), right.copy()
    for k in range(len(levels) - 1, -1, -1):
        x, y = number[a], number[b]
        equal = (x >= 0) & (y >= 0) & (levels[k][x] == levels[k][y])
        step = np.where(equal, shallow << k, 0)
        a, b = a + step, b + step
    for _ in range(shallow - 1):
        equal = padded[a] == padded[b]
        a, b = a + equal, b + equal
    return left, right, a - left


def _united(left: np.ndarray, right: np.ndarray, shared: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """The start of every run, by its period and the place after its end."""
    order = np.argsort(-shared, kind="stable")
    parent: dict[int, int] = {}
    places: dict[int, _Places] = {}
    runs: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        up = parent.setdefault(x, x)
        if up == x:
            return x
        while parent[up] != up:
            parent[x] = up = parent[parent[up]]
            x = up
            up = parent[x]
        return up

    def seed(first: int, second: int, prefix: int) -> None:
        period = second - first
        if prefix >= (times - 1) * period and prefix + period >= least:
            runs.setdefault((period, second + prefix), first)

    for a, b, prefix in zip(left[order].tolist(), right[order].tolist(), shared[order].tolist(), strict=True):
        a, b = root(a), root(b)
        into, of = places.get(a) or _Places(a), places.get(b) or _Places(b)
        if into.n < of.n:
            a, b, into, of = b, a, of, into
        coming = list(of)
        for k, p in enumerate(coming):
            before, after = into.add(p)
            if before >= 0 and (not k or before > coming[k - 1]):
                seed(before, p, prefix)
            if after >= 0 and (k + 1 == len(coming) or after < coming[k + 1]):
                seed(p, after, prefix)
        parent[b] = a
        places[a] = into
        places.pop(b, None)
    return runs


def word_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, length and period of every run of texts of ``sizes`` words, given one after the other as numbers.

    Runs come in the order of text, start and period.
    """
    n = len(sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    of = np.repeat(np.arange(n), sizes)
    own = mixed(words + mixed(of.astype(np.uint64)))  # words of different texts differ
    dense = np.unique(own, return_inverse=True)[1] if len(own) else np.zeros(0, np.int64)
    line = np.empty(len(words) + n, np.int64)
    line[np.arange(len(words)) + of] = dense
    line[begin[1:] + np.arange(n)] = len(words) + np.arange(n)
    shallow = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    found = _united(*_neighbours(line, shallow), least, times) if n else {}
    period, end = np.array(list(found), np.int64).reshape(-1, 2).T
    start = np.fromiter(found.values(), np.int64, len(found))
    text = np.searchsorted(begin + np.arange(n + 1), start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - begin[text] - text)[order], (end - start)[order], period[order]


def cycled(n: int, h: int) -> tuple[int, int] | None:
    """Where the words of a text start to repeat and with which period, by the row's number ``h``; none for most rows."""
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _true_runs(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> bool:
    return all(words[s : s + n - q] == words[s + q : s + n] for s, n, q in zip(start, length, period, strict=True))


def _of_slice(data: np.ndarray, at: np.ndarray, first: int, last: int, numbers: list[int | None], least: int, times: int) -> Iterator[tuple]:
    """Number of words, runs, and the remaining text of each text in rows [first, last)."""
    buffer, begin = joined(data, at, first, last)
    starts, ends, _ = word_ranges(buffer)
    hashes = range_hashes(buffer, starts, ends)
    bound = np.searchsorted(starts, begin)
    pick: dict[int, np.ndarray] = {}
    for d, h in enumerate(numbers):
        cycle = None if h is None else cycled(int(bound[d + 1] - bound[d]), h)
        if cycle:
            a, p = cycle
            places = np.arange(bound[d + 1] - bound[d])
            places[a:] = a + (places[a:] - a) % p
            hashes[bound[d] : bound[d + 1]] = hashes[bound[d] + places]
            pick[d] = places
    text, start, length, period = word_runs(hashes, np.diff(bound), least, times)
    edge = np.searchsorted(text, np.arange(last - first + 1))
    whole = memoryview(data)
    for d in range(last - first):
        words = bytes(whole[at[first + d] : at[first + d + 1]]).split()
        if d in pick:
            words = [words[i] for i in pick[d].tolist()]
        runs = [x[edge[d] : edge[d + 1]] for x in (start, length, period)]
        if len(runs[0]):
            if not _true_runs(words, *(x.tolist() for x in runs)):
                exact: dict[bytes, int] = {}
                ids = np.fromiter((exact.setdefault(w, len(exact)) for w in words), np.uint64, len(words))
                runs = list(word_runs(ids, np.array([len(words)]), least, times)[1:])
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, runs[0] + runs[2], 1)
            np.add.at(drop, runs[0] + runs[1], -1)
            kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        else:
            kept = words
        yield len(words), runs, b" ".join(kept)


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            numbers = batch.column("_number").to_pylist()
            for first, last in slices(at):
                n_words, runs, kept = zip(*_of_slice(data, at, first, last, numbers[first:last], least, times), strict=True)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in runs]))), pa.int32())
                fields = [pa.array(np.concatenate([r[k] for r in runs]), pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, last - first),
                        "n_words": pa.array(n_words, pa.int64()),
                        "runs": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                        "collapsed": pa.array(kept, pa.binary()).cast(pa.string()),
                    }
                )

    return run


def periodic_runs(docs: DataFrame, text: str = "text", number: str | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row.

    Words are stretches without ASCII blanks, numbered from 0.  A run has a smallest period q, a length of
    ``least`` and ``times * q`` words at least, and no neighbouring word that goes on with the period.
    ``collapsed`` is the words, joined by blanks, without those that lie after the first q words of a run.
    With ``number``, a column of non-negative longs, rows whose number h is divisible by 10 have their words
    from a = (h div 10) mod n on replaced by a cycle (``cycled``), so that runs of any length can be asked for.

    A null text has no words, as has an empty or blank one: no runs, collapsed empty.  A null number
    replaces nothing.  Rows are judged one by one: repeated rows get equal answers, a null doc_id stays null,
    and other columns of ``docs`` are not looked at.  ``times`` is 2 or more.  One text is the unit of work
    of a task; memory grows with the longest.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = docs.select("doc_id", filled(text).alias("_text"), (F.col(number).cast("long") if number else F.lit(None).cast("long")).alias("_number"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_found(least, times), f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (least start, then period, among equals) with its exponent in thousandths, and SHA-256 of runs and remaining text."""
    longest = F.element_at(F.array_sort("runs", lambda a, b: F.when(a.length != b.length, F.when(a.length > b.length, -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).otherwise(F.when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    some = F.size("runs") > 0
    rows = found.select("doc_id", "runs", "collapsed", F.when(some, longest).alias("_top"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"),
        F.col("_top.length").alias("length"),
        F.col("_top.period").alias("period"),
        F.expr("(1000 * _top.length) div _top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    numbered = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_number"))
    return run_digests(periodic_runs(numbered, number="_number"))
