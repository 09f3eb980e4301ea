"""Removal of byte strings that an earlier document holds too, by column-wise collection suffix sorting.

Every string of 50 bytes has one anchor: the leftmost of its 26-byte pieces with the least hash.  Equal
strings have equal anchors at equal places, so all occurrences of a string meet under the hash of its
anchor.  A task cuts its texts into contexts, each the bytes of the neighbouring strings that share one
anchor (50 to 74 bytes), and a collection of short contexts is what the column-wise construction of the
Burrows-Wheeler transform is made for.

1. Copies of one text are one text, with the smallest doc_id; other rows of it need no further look.
2. Texts are dealt over blocks once; the later steps read the same shuffle again.
3. Anchors meet by hash, five bytes each; a block sends an anchor once, however many of its texts have it, and
   whether it is several.  A bit an anchor goes back to the blocks: does another text have it.
   One in 64 contexts, by content, is counted too; it shows the anchors with more contexts than one transform takes.
4. Contexts of shared anchors meet by the same hash; those of the anchors found to be hot are cut into single
   strings, which meet by their own hash, spread over parts of their own.  A block sends a context once, with
   the smallest doc_id that has it there; equal contexts are stored once; the transform of the collection, with
   common prefixes of 50 or more, names equal strings, and every string its smallest doc_id.
5. Strings that start in a document of another block, earlier than all of this one, go back to the blocks as runs.
   Each block adds the strings of its own later documents with the same context and removes the bytes.

So one line in a third of all documents is one row of each block in the part where it meets, and its
occurrences stay with their blocks.  Every block sends to every part; so that these pairs do not grow with the
square of the input, blocks and parts grow with its root, within bounds.  Steps 3 and 4 spread a passage that many documents share over as many
keys as it has anchors, and a collection that has grown too large for one transform is divided by anchor, then
by the hash of the string.  The transform decides which strings of shared anchors are equal; that strings of
unshared anchors have no equal is decided by the anchors' hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.arrays import _tables, mixed, text_bytes
from colonnade.llm.collection_bwt import suffix_groups
from colonnade.llm.tables import filled, parts, table

LENGTH = 50
#: Bytes of text in a block, bytes of text whose anchors make one part, and contexts in one transform.
BLOCK = 4 << 20
PART = 5 << 20
CONTEXTS = 20_000
#: Over ``WHOLE`` blocks, blocks and parts grow with the square root of the input, to ``GROWTH`` times their size at most:
#: every block sends to every part, and their pairs would grow with the square of the input.
WHOLE = 256
GROWTH = 4
#: Contexts that one transform holds at a time, if their anchors can be divided; its arrays then stay in the processor's cache.
COLLECTION = 4000
#: Contexts whose runs are looked for at a time.
RUNS = 1 << 15
#: Strings whose anchors a task looks for at a time.
STRIDE = 1 << 18
#: One context in ``SAMPLE`` is counted, and parts for strings of hot anchors for each other part.
SAMPLE = 64
SPREAD = 8

_LAST = np.iinfo(np.int64).max  # stands for a null doc_id: later than all others
_SIDE = "_block long, kind int, part long, blob binary"


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First string, number of strings, hash, and hash of the context of every anchor of the texts, in the order of the bytes."""
    piece = length // 2 + 1
    width = length - piece + 1
    power, inverse = _tables(STRIDE + length + 1)
    for low in range(0, max(0, len(data) - length + 1), STRIDE):
        high = min(low + STRIDE, len(data) - length + 1)  # strings start in [low, high)
        bytes_ = data[low : high + length - 1]
        total = np.zeros(len(bytes_) + 1, np.uint64)
        np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * power[: len(bytes_)], out=total[1:])
        n = len(bytes_) - piece + 1
        h = (total[piece:] - total[:n]) * inverse[:n]
        key = h * np.uint64(0xD1B54A32D192ED03)
        key = ((key >> np.uint64(32)) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        spot = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = np.ones(high - low, bool)
        first = int(np.searchsorted(at, low, side="right"))
        last = int(np.searchsorted(at, high + length, side="left"))
        for end in at[first : last + 1].tolist():
            valid[max(0, end - length + 1 - low) : max(0, end - low)] = False
        change = np.flatnonzero(valid & np.concatenate(([True], (spot[1:] != spot[:-1]) | ~valid[:-1])))
        stop = np.flatnonzero(valid & np.concatenate(((spot[1:] != spot[:-1]) | ~valid[1:], [True])))
        context = (total[stop + length] - total[change]) * inverse[change] + (stop - change).astype(np.uint64)
        yield low + change, stop - change + 1, mixed(h[spot[change]]), mixed(context)


def _texts_of(docs: pa.Table, side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The distinct texts of a block in the order of their keys: bytes, bounds, doc_ids, keys."""
    first = {(r["blob"][8:].decode(), int.from_bytes(r["blob"][:8], "big", signed=True)) for r in side.filter(pa.compute.equal(side["kind"], 0)).to_pylist()}
    ids = docs["_id"].to_numpy(zero_copy_only=False)
    keys = docs["_key"].to_pylist()
    chosen = {k: i for i, k in enumerate(keys) if (k, int(ids[i])) in first}
    order = [chosen[k] for k in sorted(chosen)]
    pa.default_memory_pool().release_unused()  # of the block before
    data, at = text_bytes(docs["_text"].take(pa.array(order, pa.int64())))
    return data, at, ids[order], sorted(chosen)


def _pairs(data: np.ndarray, at: np.ndarray, length: int, buckets: int) -> dict[str, np.ndarray]:
    """Anchors of a block by part and hash: places, texts, and the number that an anchor's hash has in the block."""
    found = list(anchors(data, at, length))
    start, strings, h, content = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    h, content = h.astype(np.uint64), content.astype(np.uint64)
    row = np.searchsorted(at, start, side="right") - 1
    short, part = h & np.uint64((1 << 40) - 1), (h >> np.uint64(44)) % np.uint64(buckets)
    both = part << np.uint64(40) | short if buckets <= 1 << 24 else None
    order = np.lexsort((short, part)) if both is None else np.argsort(both, kind="stable")  # found in the order of their places
    start, strings, short, row, part, content = start[order], strings[order], short[order], row[order], part[order], content[order]
    new = np.ones(len(h), bool)
    new[1:] = (short[1:] != short[:-1]) | (part[1:] != part[:-1])
    several = np.zeros(int(new.sum()), bool)  # the anchor is in more than one text
    number = np.cumsum(new) - 1
    several[number[1:][~new[1:] & (row[1:] != row[:-1])]] = True
    return {"start": start, "strings": strings, "h": short, "row": row, "part": part.astype(np.int64), "number": number, "new": new, "several": several, "content": content}


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    bound = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else [0]
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        yield int(keys[a]), int(a), int(b)


def _side_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    block, kind, part, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"_block": pa.array(block, pa.int64()), "kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int64()), "blob": pa.array(blob, pa.binary())})


def _block_of(*tables: pa.Table) -> int:
    return next(t["_block"][0].as_py() for t in tables if len(t))


def _announce(length: int, buckets: int):
    """Step 3, from the blocks: the anchors of each part, five bytes each, and which are in several texts; anchor and content of the counted contexts."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        data, at, _, _ = _texts_of(docs, side)
        found = _pairs(data, at, length, buckets)
        h, part = found["h"][found["new"]], found["part"][found["new"]]
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8)
        block = _block_of(docs, side)
        counted = np.flatnonzero(found["content"] % np.uint64(SAMPLE) == 0)
        counted = counted[np.lexsort((found["content"][counted], found["h"][counted], found["part"][counted]))]
        pairs, where = np.stack([found["h"][counted], found["content"][counted]], axis=1), found["part"][counted]
        once = np.ones(len(counted), bool)
        once[1:] = (pairs[1:] != pairs[:-1]).any(axis=1) | (where[1:] != where[:-1])
        pairs, where = pairs[once], where[once]
        return _side_table(
            [(block, 1, p, np.int64(b - a).tobytes() + low[a:b].tobytes() + high[a:b].tobytes() + np.packbits(found["several"][a:b]).tobytes()) for p, a, b in _groups(part)]
            + [(block, 3, p, pairs[a:b].tobytes()) for p, a, b in _groups(where)]
        )

    return run


def _shared(contexts: int):
    """Step 3, in a part: for each block, which of its hashes another text has too, and then, if any, which are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [r for b in batches for r in b.to_pylist()]
        rows = [r for r in every if r["kind"] == 1]
        sizes = [int(np.frombuffer(r["blob"], np.int64, 1)[0]) for r in rows]
        h = np.concatenate([np.frombuffer(r["blob"], np.uint32, n, 8).astype(np.uint64) | np.frombuffer(r["blob"], np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32) for r, n in zip(rows, sizes, strict=True)])
        several = np.concatenate([np.unpackbits(np.frombuffer(r["blob"], np.uint8, -1, 8 + 5 * n), count=n) for r, n in zip(rows, sizes, strict=True)])
        ranked = np.sort(h)
        twice = np.unique(np.concatenate((ranked[1:][ranked[1:] == ranked[:-1]], h[several == 1])))
        spot = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
        hit = twice[spot] == h if len(twice) else np.zeros(len(h), bool)
        counted = [np.frombuffer(r["blob"], np.uint64).reshape(-1, 2) for r in every if r["kind"] == 3]
        hot = np.zeros(len(h), bool)
        if counted:
            anchor, many = np.unique(np.unique(np.concatenate(counted), axis=0)[:, 0], return_counts=True)
            hot = hit & np.isin(h, anchor[many * SAMPLE > contexts])
        out, at = [], 0
        for r, n in zip(rows, sizes, strict=True):
            own, burning = hit[at : at + n], hot[at : at + n]
            if own.any():
                out.append((r["_block"], 1, r["part"], np.packbits(own).tobytes() + (np.packbits(burning).tobytes() if burning.any() else b"")))
            at += n
        yield from _side_table(out).to_batches()

    return run


def _string_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of the string at every start."""
    power, out = _tables(length)[0][:length], np.empty(len(start), np.uint64)
    for k in range(0, len(start), 1 << 15):
        some = start[k : k + (1 << 15)]
        total = np.zeros(len(some), np.uint64)
        for j in range(length):
            total += (data[some + j].astype(np.uint64) + np.uint64(1)) * power[j]
        out[k : k + (1 << 15)] = mixed(total)
    return out


def _contexts(length: int, buckets: int):
    """Step 4, from the blocks: contexts of shared anchors, each once, with its smallest doc_id.

    Its other texts start none of its strings first; those strings, and the places of the first text, stay
    with the block: they pass through the shuffle in rows of their own, dealt evenly.
    """

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        block = _block_of(docs, side)
        bits = {r["part"]: r["blob"] for r in side.filter(pa.compute.equal(side["kind"], 1)).to_pylist()}
        if not bits:
            return _side_table([])
        data, at, ids, _ = _texts_of(docs, side)
        found = _pairs(data, at, length, buckets)
        packer = zstandard.ZstdCompressor(level=3)
        raw, rows = data.tobytes(), []

        def pack(part: int, start: np.ndarray, size: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> None:
            number: dict[bytes, int] = {}
            context = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)), np.int64, len(start))
            anchor = hashes[np.diff(np.maximum.accumulate(context), prepend=-1) > 0] & np.uint64(0xFFFFFFFF)  # where each is first met
            least = np.full(len(number), _LAST)
            np.minimum.at(least, context, ids[row])
            later = ids[row] > least[context]
            place, strings = start - at[row], size - length + 1
            sent = (np.array([len(number)], np.int64), np.fromiter(map(len, number), np.uint16, len(number)), anchor.astype(np.uint32), least)
            rows.append((block, 2, part, b"".join([*(x.tobytes() for x in sent), packer.compress(b"".join(number))])))
            rest = mixed(np.array([block * 0x9E3779B1 + part], np.uint64))[0] % np.uint64(buckets)
            held = np.stack([context[~later], row[~later], place[~later]]).astype(np.uint32)
            rows.append((block, 4, int(rest), np.int64(part).tobytes() + packer.compress(held.tobytes())))
            if later.any():
                gone = np.stack([row[later], place[later], strings[later]]).astype(np.uint32)
                rows.append((block, 5, int(rest), packer.compress(gone.tobytes())))

        burning = []
        for p, a, b in _groups(found["part"]):
            if p not in bits:
                continue
            number = found["number"][a:b] - found["number"][a]
            width = -(-(int(number[-1]) + 1) // 8)
            flags = np.frombuffer(bits[p], np.uint8)
            own = a + np.flatnonzero(np.unpackbits(flags[:width])[number])
            if len(flags) > width:
                hot = np.unpackbits(flags[width:])[number[own - a]] == 1
                burning.append(own[hot])
                own = own[~hot]
            if len(own):
                pack(p, found["start"][own], found["strings"][own] + length - 1, found["h"][own], found["row"][own])
        if burning:
            own = np.concatenate(burning)
            many = found["strings"][own]
            start = np.repeat(found["start"][own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            row = np.repeat(found["row"][own], many)
            salt = _string_hashes(data, start, length)
            part = (buckets + ((salt >> np.uint64(32)) % np.uint64(SPREAD * buckets)).astype(np.int64)).astype(np.int64)
            order = np.lexsort((start, part))
            start, row, salt, part = start[order], row[order], salt[order], part[order]
            for p, a, b in _groups(part):
                pack(p, start[a:b], np.full(b - a, length), salt[a:b], row[a:b])
        return _side_table(rows)

    return run


def _unpacked(blob: bytes, unpack=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Sizes, anchors, smallest doc_ids and bytes of the contexts that a block sends to a part."""
    unpack = unpack or zstandard.ZstdDecompressor().decompress
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    out, at = [], 8
    for kind in (np.uint16, np.uint32, np.int64):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return *out, unpack(blob[at:])


def _named_strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, least: np.ndarray, length: int, most: int = CONTEXTS) -> np.ndarray:
    """The smallest doc_id of every string of every context, context by context."""
    begin = np.concatenate(([0], np.cumsum(size - length + 1)))
    out = np.empty(int(begin[-1]), np.int64)

    def collection(which: np.ndarray) -> None:
        offsets = np.concatenate(([0], np.cumsum(size[which])))
        joined = data[np.arange(offsets[-1]) + np.repeat(start[which] - offsets[:-1], size[which])]
        numbers, at = suffix_groups(joined, offsets[:-1], size[which], length)
        many = np.diff(at)
        smallest = np.full(int(numbers.max()) + 1, _LAST)
        np.minimum.at(smallest, numbers, np.repeat(least[which], many))
        out[np.arange(at[-1]) + np.repeat(begin[which] - at[:-1], many)] = smallest[numbers]

    def single(which: np.ndarray) -> None:
        """Contexts of one anchor that are too many for one transform: collections of single strings, by their hash."""
        many = size[which].astype(np.int64) - length + 1
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        spot, place, smallest = np.repeat(begin[which], many) + k, np.repeat(start[which], many) + k, np.repeat(least[which], many)
        share = _string_hashes(data, place, length) % np.uint64(-(-len(place) // most))
        order = np.argsort(share)
        for _, a, b in _groups(share[order].astype(np.int64)):
            own = order[a:b]
            joined = data[place[own][:, None] + np.arange(length)].ravel()
            numbers, _ = suffix_groups(joined, np.arange(len(own)) * length, np.full(len(own), length), length)
            first = np.full(int(numbers.max()) + 1, _LAST)
            np.minimum.at(first, numbers, smallest[own])
            out[spot[own]] = first[numbers]

    divisions = -(-len(start) // min(most, COLLECTION))
    share = mixed(anchor.astype(np.uint64)) % np.uint64(max(1, divisions))
    for d in range(divisions):
        which = np.flatnonzero(share == d)
        if len(which) > 4 * most:
            kinds, inverse, many = np.unique(anchor[which], return_inverse=True, return_counts=True)
            for k in np.flatnonzero(many > most):
                single(which[inverse == k])
            which = which[many[inverse] <= most]
        if len(which):
            collection(which)
    return out


def _runs_of(held: list[tuple[int, int, np.ndarray, np.ndarray]], begin: np.ndarray, smallest: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """For every block and part, the runs of strings in its contexts that start in an earlier document than the context does."""
    context, first = (np.concatenate([h[k] for h in held]) for k in (2, 3))
    at = np.concatenate(([0], np.cumsum([len(h[2]) for h in held])))
    many = begin[context + 1] - begin[context]
    offset = np.cumsum(many) - many
    which = np.repeat(np.arange(len(context)), many)
    k = np.arange(len(which)) - offset[which]
    earlier = smallest[begin[context][which] + k] < first[which]
    change = which[1:] != which[:-1]
    opens = np.flatnonzero(earlier & np.concatenate(([True], ~earlier[:-1] | change)))
    closes = np.flatnonzero(earlier & np.concatenate((~earlier[1:] | change, [True])))
    which, k, strings = which[opens], k[opens].astype(np.uint32), (closes - opens + 1).astype(np.uint32)
    bound = np.searchsorted(which, at).tolist()
    rows = []
    for (block, part, _, _), n, a, b in zip(held, at.tolist(), bound[:-1], bound[1:], strict=False):
        if a < b:
            rows.append((block, 2, part, np.int64(part).tobytes() + (which[a:b] - n).astype(np.uint32).tobytes() + k[a:b].tobytes() + strings[a:b].tobytes()))
    return rows


def _resolved(length: int, contexts: int):
    """Step 4, in a part: for each block the runs of strings that a document earlier than all of its own has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        anchor: list[np.ndarray] = []
        held, unpack = [], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            here = pa.compute.equal(batch["kind"], 2)
            alone = batch.filter(pa.compute.invert(here))  # of the block alone
            if len(alone):
                yield alone
            for r in batch.filter(here).to_pylist():
                size, hashes, first, raw = _unpacked(r["blob"], unpack)
                ends = np.cumsum(size.astype(np.int64))
                before = len(number)
                own = np.fromiter((number.setdefault(raw[e - n : e], len(number)) for e, n in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(size))
                anchor.append(hashes[own >= before])
                held.append((r["_block"], r["part"], own, first))
        if not held:
            return
        data = np.frombuffer(b"".join(number), np.uint8)
        size = np.fromiter(map(len, number), np.int64, len(number))
        number.clear()
        start = np.cumsum(size) - size
        least = np.full(len(size), _LAST)
        for _, _, context, first in held:
            np.minimum.at(least, context, first)
        smallest = _named_strings(data, start, size, np.concatenate(anchor), least, length, contexts)
        begin = np.concatenate(([0], np.cumsum(size - length + 1)))
        ends = np.cumsum([len(context) for _, _, context, _ in held])
        a = 0
        while a < len(held):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + RUNS, side="right")))
            yield from _side_table(_runs_of(held[a:b], begin, smallest)).to_batches()
            a = b

    return run


def _gone(side: pa.Table) -> np.ndarray | None:
    """Text, place and number of all runs of strings to remove from a block's texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = {kind: side.filter(pa.compute.equal(side["kind"], kind))["blob"].to_pylist() for kind in (2, 4, 5)}
    triples = lambda blob: np.frombuffer(blob, np.uint32).reshape(3, -1)
    out = [triples(unpack(blob)) for blob in rows[5]]
    runs = {blob[:8]: triples(blob[8:]) for blob in rows[2]}
    if runs:
        places = {blob[:8]: triples(unpack(blob[8:])) for blob in rows[4] if blob[:8] in runs}
        spans = np.cumsum([0, *(int(places[part][0].max()) + 1 for part in runs)])  # contexts are numbered on from part to part
        which, k, many = np.concatenate([np.stack([r[0] + np.int64(n), r[1], r[2]]) for r, n in zip(runs.values(), spans[:-1].tolist(), strict=True)], axis=1)
        context, row, place = np.concatenate([np.stack([places[part][0] + np.int64(n), *places[part][1:]]) for part, n in zip(runs, spans[:-1].tolist(), strict=True)], axis=1)
        order = np.argsort(context, kind="stable")
        first, last = np.searchsorted(context[order], which, "left"), np.searchsorted(context[order], which, "right")
        times = last - first
        run = np.repeat(np.arange(len(which)), times)
        spot = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first[run]]
        out.append(np.stack([row[spot], place[spot] + k[run], many[run]]))
    return np.concatenate(out, axis=1).astype(np.int64) if out else None


def _changed(docs: pa.Table, side: pa.Table, length: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, bytes]]:
    """Key, starts and lengths of the removed runs, and the remaining bytes of every text of a block that loses some."""
    hits = _gone(side)
    if hits is None:
        return
    data, at, _, keys = _texts_of(docs, side)
    row, start, strings = hits
    first = at[row] + start
    edge = np.bincount(first, minlength=len(data) + 1) - np.bincount(first + strings + length - 1, minlength=len(data) + 1)
    covered = np.cumsum(edge)[: len(data)] > 0
    for r in np.unique(row).tolist():
        own, text = covered[at[r] : at[r + 1]], data[at[r] : at[r + 1]]
        bound = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).view(np.int8)))
        yield keys[r], bound[0::2], bound[1::2] - bound[0::2], text[~own].tobytes()


def _removed(length: int):
    """Step 5: spans of every changed text, and the bytes that remain."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        found = list(_changed(docs, side, length))
        longs = pa.list_(pa.int64())
        kinds = {"_key": pa.string(), "starts": longs, "lengths": longs, "kept": pa.binary()}
        return pa.table({k: pa.array([f[i] for f in found], t) for i, (k, t) in enumerate(kinds.items())})

    return run


def _remaining(length: int):
    """Step 5, for whole rows: the first rows of each text with what remains of it; those that keep no word go, as do later copies."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        kept = {key: text.decode("utf-8", "ignore") for key, _, _, text in _changed(docs, side, length)}
        first = {(r["blob"][8:].decode(), int.from_bytes(r["blob"][:8], "big", signed=True)) for r in side.filter(pa.compute.equal(side["kind"], 0)).to_pylist()}
        keys, ids = docs["_key"].to_pylist(), docs["_id"].to_pylist()
        stay = [i for i, k in enumerate(keys) if (k, ids[i]) in first and (k not in kept or kept[k].encode().split(None, 1))]
        rows = docs.take(pa.array(stay, pa.int64()))
        texts = pa.array([kept.get(keys[i]) for i in stay], pa.string())
        return pa.table({"_row": rows["_row"], "_text": pa.compute.coalesce(texts, rows["_text"])})

    return run


def keyed(docs: DataFrame, text: str = "text", *more: Column) -> DataFrame:
    """doc_id, _id (a long; nulls last), _key (SHA-256 of the text), n_bytes, _text and ``more`` of every row."""
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"),
        F.sha2(F.encode(filled(text), "utf-8"), 256).alias("_key"),
        F.octet_length(filled(text)).cast("long").alias("n_bytes"),
        filled(text).alias("_text"),
        *more,
    )


def _dealt(spark: SparkSession, total: int) -> tuple[int, int]:
    """Blocks of texts and parts of anchors for so many bytes."""
    growth = min(GROWTH, max(1, (total / (WHOLE * BLOCK)) ** 0.5))
    return parts(spark, total, int(BLOCK * growth)), parts(spark, total, int(PART * growth))


def _visited(docs: DataFrame, text: str, length: int, step, schema: str | T.StructType, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The first document of every text (_key, _first), and what ``step`` makes of the blocks of texts in the end."""
    spark = docs.sparkSession
    rows = keyed(docs, text)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    blocks, buckets = _dealt(spark, total)
    firsts = rows.groupBy("_key").agg(F.min("_id").alias("_first"))
    block = lambda *c: F.pmod(F.xxhash64(*c), F.lit(blocks)).alias("_block")
    texts = (rows if row is None else keyed(docs, text, row.alias("_row"))).drop("doc_id", "n_bytes").withColumn("_block", block("_key", "_id")).repartition(blocks, "_block")
    first_side = firsts.select(
        F.col("_first").alias("_id"), "_key"
    ).select(
        block("_key", "_id"),
        F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("part"),
        F.concat(F.unhex(F.lpad(F.hex("_id"), 16, "0")), F.encode("_key", "utf-8")).alias("blob"),
    )

    def visit(side: DataFrame, step, schema: str | T.StructType) -> DataFrame:
        return texts.groupBy("_block").cogroup(side.groupBy("_block")).applyInArrow(step, schema)

    announced = visit(first_side, _announce(length, buckets), _SIDE)
    shared = announced.groupBy("part").applyInArrow(_shared(CONTEXTS), _SIDE)
    contexts = visit(first_side.union(shared), _contexts(length, buckets), _SIDE)
    resolved = contexts.groupBy("part").applyInArrow(_resolved(length, CONTEXTS), _SIDE)
    return firsts, visit(first_side.union(resolved), step, schema)


def changed_texts(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The first document of every text, and what goes from texts that repeat parts of earlier documents.

    The first frame has _key and _first for every distinct text.  The second has _key, starts, lengths
    (maximal removed runs of bytes) and kept (the remaining bytes) for the texts that lose some.  Later
    copies of a text are not listed: all their bytes go if there are ``length`` or more.
    """
    return _visited(docs, text, length, _removed(length), "_key string, starts array<long>, lengths array<long>, kept binary")


def removed_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every document with the spans of bytes that go and the bytes that remain.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
    doc_id, judged on the texts as given.  A null text is empty.  A null doc_id counts as later than all
    others; rows with equal doc_ids do not take from each other, and repeated rows get equal answers.
    Texts are bytes, so a span may cut a character; ``kept`` is binary.  Returns doc_id, n_bytes, starts,
    lengths, kept.
    """
    firsts, changed = changed_texts(docs, text, length)
    rows = keyed(docs, text).join(firsts, "_key").join(changed, "_key", "left")
    later = (F.col("_id") > F.col("_first")) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<long>")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(later, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(later, F.array("n_bytes")).otherwise(F.coalesce("lengths", none)).alias("lengths"),
        F.when(later, F.lit(b"")).otherwise(F.coalesce("kept", F.encode("_text", "utf-8"))).alias("kept"),
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with the remaining text in place of the text; characters that lost a byte go as a whole.

    Rows that lose bytes and keep no word go, so later copies of a text of ``length`` bytes do.  Shorter texts
    hold no such string: their rows, nulls and empty texts among them, stay as they are.  All columns stay,
    whatever their names; repeated rows are as many as before.  Texts cross the network once.
    """
    long = F.octet_length(filled(text)) >= length
    others = [f for f in docs.schema.fields if f.name != text]
    row = F.struct(*(F.col(f"`{f.name}`") for f in others)) if others else F.struct(F.lit(0).alias("_none"))
    schema = T.StructType([*docs.select(row.alias("_row")).schema.fields, T.StructField("_text", T.StringType())])
    _, found = _visited(docs.where(long), text, length, _remaining(length), schema, row)
    left = found.select(*(F.col("_text").alias(text) if f.name == text else F.col(f"_row.`{f.name}`") for f in docs.schema.fields))
    return docs.where(~long).union(left)


def removed_digests(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``removed_repeats`` without the texts: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    firsts, changed = changed_texts(docs, text, length)
    changed = changed.select(
        "_key",
        F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("gone"),
        F.size("starts").cast("long").alias("spans"),
        F.sha2("kept", 256).alias("digest"),
    )
    rows = keyed(docs, text).select("doc_id", "_id", "_key", "n_bytes").join(firsts, "_key").join(changed, "_key", "left")
    later = (F.col("_id") > F.col("_first")) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(later, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("digest", "_key")).alias("kept_sha256"),
    )


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(table(spark, sf_dir, "documents"))
