from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from colonnade.llm import collection_bwt, suffix_dedup


def test_pairs_of_blocks_and_parts_follow_the_input(spark):
    """Every block sends to every part: their pairs grow with the input, not with its square."""
    pairs = [int(np.prod(suffix_dedup._dealt(spark, gb << 30))) for gb in (1, 2, 4, 8, 16)]
    assert max(b / a for a, b in zip(pairs, pairs[1:])) < 2.1
    for gb in (1, 16, 1000):  # blocks and parts stay bounded
        blocks, parts = suffix_dedup._dealt(spark, gb << 30)
        assert blocks >= (gb << 30) / (16 << 20) and parts >= (gb << 30) / (20 << 20)


def sent(rng, blocks: int, part: int) -> list[tuple[int, int, int, bytes]]:
    """What blocks send to a part: texts of 50 bytes, some in every block, and rows that only pass through."""
    rows = []
    for b in range(blocks):
        texts = [f"{i:050d}".encode() for i in range(3)] + ["".join(rng.choice("abc") for _ in range(60)).encode()]
        packed = suffix_dedup.zstandard.ZstdCompressor().compress(b"".join(texts))
        size, anchor, least = np.array([50, 50, 50, 60], np.uint16), np.arange(4, dtype=np.uint32), np.full(4, 100 - b)
        rows.append((b, 2, part, np.int64(4).tobytes() + size.tobytes() + anchor.tobytes() + least.tobytes() + packed))
        rows += [(b, 4, part, b"places"), (b, 5, part, b"gone")]
    return rows


@pytest.mark.parametrize("at_once", [1, 1 << 15])
def test_rows_of_many_blocks_leave_a_part_together(monkeypatch, at_once):
    """A part writes its rows in few batches, whatever the number of blocks; runs are those of each block."""
    if at_once == 1:
        monkeypatch.setattr(suffix_dedup, "RUNS", at_once)
    blocks, part = 40, 7
    rows = sent(random.Random(4), blocks, part)
    got = list(suffix_dedup._resolved(50, 20_000)(iter(suffix_dedup._side_table(rows).to_batches())))
    out = pa.Table.from_batches(got).to_pylist()
    assert sorted((r["_block"], r["kind"], r["blob"]) for r in out if r["kind"] != 2) == sorted((b, k, x) for b, k, _, x in rows if k != 2)
    runs = {r["_block"]: np.frombuffer(r["blob"], np.uint32, -1, 8).reshape(3, -1).tolist() for r in out if r["kind"] == 2}
    assert runs == {b: [[0, 1, 2], [0, 0, 0], [1, 1, 1]] for b in range(blocks - 1)}  # all but the one with the smallest doc_id
    assert at_once == 1 or len(got) <= 4


def test_gone_runs_of_many_parts():
    """Runs of one block from several parts are put back at the places of their own part's contexts."""
    pack = suffix_dedup.zstandard.ZstdCompressor().compress
    triple = lambda *x: np.array(x, np.uint32).tobytes()
    part = lambda p: np.int64(p).tobytes()
    rows = [(0, 2, 0, part(9) + triple([1, 0], [2, 0], [3, 1])), (0, 2, 0, part(4) + triple([0], [5], [6]))]
    rows += [(0, 4, 0, part(4) + pack(triple([0, 1, 0], [3, 4, 5], [30, 40, 50]))), (0, 4, 0, part(9) + pack(triple([1, 0], [7, 8], [70, 80])))]
    rows += [(0, 4, 0, part(5) + pack(triple([0], [1], [1]))), (0, 5, 0, pack(triple([2], [20], [1]))), (0, 0, 0, b"x")]
    got = suffix_dedup._gone(suffix_dedup._side_table(rows))
    assert sorted(zip(*got.tolist())) == [(2, 20, 1), (3, 35, 6), (5, 55, 6), (7, 72, 3), (8, 80, 1)]
    assert suffix_dedup._gone(suffix_dedup._side_table([(0, 0, 0, b"x")])) is None


def test_transform_takes_two_bytes_a_round(monkeypatch):
    """Strings of up to 74 bytes need 37 rounds, each of which rewrites both arrays."""
    writes = []
    plain = collection_bwt._File.write
    monkeypatch.setattr(collection_bwt._File, "write", lambda self, values: (writes.append(len(values)), plain(self, values))[1])
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 74))).encode() for _ in range(60)] + [b"a" * 74, b"ab" * 37]
    size = np.array([len(t) for t in texts])
    numbers, begin = collection_bwt.suffix_groups(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, 50)
    strings = [t[k : k + 50] for t in texts for k in range(len(t) - 49)]
    assert len(set(zip(numbers.tolist(), strings, strict=True))) == len(set(numbers.tolist())) == len(set(strings))
    assert len(writes) == 2 * 38
