from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from colonnade.llm import sharding
from tests.llm.conftest import wide


def one(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for n in (1, 2, 7, 24, 1000):
        assert sharding.jump(keys, n).tolist() == [one(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


@pytest.mark.parametrize("numbered", [50_000, 2])
def test_shards(docs, monkeypatch, numbered):
    monkeypatch.setattr(sharding, "NUMBERED", numbered)
    rows = sharding.sharded(wide(docs)).collect()
    given = docs.collect()
    assert len(rows) == len(given)
    expect = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in given)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expect
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})


def test_repeated_rows_have_slots_of_their_own(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "NUMBERED", 50)
    monkeypatch.setattr(sharding, "_PIECE", 64)
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    rows = sharding.sharded(same.unionByName(spark.range(200).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))).collect()
    assert len(rows) == 3200 and sum(r.doc_id is None for r in rows) == 3000
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_empty(empty):
    assert sharding.sharded(empty).count() == 0
