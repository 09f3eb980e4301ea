from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colonnade.llm import suffix_dedup
from tests.llm.conftest import SCHEMA
from tests.llm.test_suffix_dedup import plain

LINE = "Licensed under an invented licence, v9"


def licensed(n: int) -> list[str]:
    """Texts with one line of 38 bytes in different surroundings, each met twice."""
    rng = random.Random(7)
    own = ["".join(rng.choice("abcdefghij klmnop") for _ in range(120)) for _ in range(n)]
    return [f"{i} {t[:60]} {LINE} {t[60:]}" for i, t in enumerate(own + own[: n // 4])]


def test_hot_anchor_is_spread():
    """No part gathers the contexts of the one anchor that all texts share."""
    texts, buckets, most = licensed(2000), 16, 100
    keys = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    docs = pa.table({"_id": np.arange(len(texts)), "_key": keys, "_text": texts, "_block": np.zeros(len(texts), np.int64)})
    first = suffix_dedup._side_table([(0, 0, 0, i.to_bytes(8, "big", signed=True) + k.encode()) for i, k in enumerate(keys)])
    announced = suffix_dedup._announce(50, buckets)(docs, first)
    shared = []
    for p in sorted(set(announced["part"].to_pylist())):
        own = announced.filter(pa.compute.equal(announced["part"], p))
        shared += suffix_dedup._shared(most)(own.to_batches())
    side = pa.concat_tables([first, pa.Table.from_batches(shared)])
    contexts = suffix_dedup._contexts(50, buckets)(docs, side)
    held = Counter()
    for r in contexts.filter(pa.compute.equal(contexts["kind"], 2)).to_pylist():
        held[r["part"]] += len(suffix_dedup._unpacked(r["blob"])[0])
    assert max(held.values()) < 0.1 * sum(held.values())


@pytest.mark.parametrize("contexts", [50, 20_000])
def test_shared_line_against_plain_lookup(spark, monkeypatch, contexts):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(licensed(1000))], SCHEMA)
    assert Counter(tuple(r) for r in suffix_dedup.removed_digests(docs).collect()) == Counter(plain(docs.collect(), 50))


def test_strings_of_one_anchor_by_transform():
    """Contexts of one anchor that come to one task are divided by string, and the transform names equal ones."""
    rng = random.Random(2)
    texts = list({"".join(rng.choice("ab") for _ in range(12)) for _ in range(900)})
    size = np.full(len(texts), 12)
    least = np.array([rng.randrange(1000) for _ in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = suffix_dedup._named_strings(data, np.cumsum(size) - size, size, np.zeros(len(texts), np.uint32), least, 8, 20)
    strings = [(t[k : k + 8], least[i]) for i, t in enumerate(texts) for k in range(5)]
    first = {}
    for s, d in strings:
        first[s] = min(first.get(s, d), d)
    assert got.tolist() == [first[s] for s, _ in strings]


@pytest.mark.parametrize("n", [200, 2000])
def test_one_line_in_all_texts_is_one_row_a_block(n):
    """What a block sends to the part where an equal line meets does not grow with the texts that hold it."""
    rng, line, buckets = random.Random(3), "An equal line of more than fifty bytes, which every text holds between others.", 16
    texts = [f"{''.join(rng.choice('abcdefghij klmnop') for _ in range(70))}\n{line * 2}\n{''.join(rng.choice('abcdefghij klmnop') for _ in range(70))}" for _ in range(n)]
    keys = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    docs = pa.table({"_id": np.arange(n), "_key": keys, "_text": texts, "_block": np.zeros(n, np.int64)})
    first = suffix_dedup._side_table([(0, 0, 0, i.to_bytes(8, "big", signed=True) + k.encode()) for i, k in enumerate(keys)])
    announced = suffix_dedup._announce(50, buckets)(docs, first)
    inside = pa.table({"_id": [0], "_key": [keys[0]], "_text": [line * 2], "_block": [0]})
    hot = suffix_dedup._pairs(*suffix_dedup.text_bytes(inside["_text"]), 50, buckets)
    part, h = int(hot["part"][0]), int(hot["h"][0])
    sent = [r["blob"] for r in announced.to_pylist() if r["kind"] == 1 and r["part"] == part][0]
    low = np.frombuffer(sent, np.uint32, int(np.frombuffer(sent, np.int64, 1)[0]), 8)
    assert (low == h & 0xFFFFFFFF).sum() == 1
    shared = suffix_dedup._shared(10**9)(announced.filter(pa.compute.equal(announced["part"], part)).to_batches())
    contexts = suffix_dedup._contexts(50, buckets)(docs, pa.concat_tables([first, pa.Table.from_batches(shared)]))
    (row,) = [r for r in contexts.to_pylist() if r["kind"] == 2 and r["part"] == part]
    size, anchor, least, raw = suffix_dedup._unpacked(row["blob"])
    texts_of = [raw[e - k : e] for e, k in zip(np.cumsum(size.astype(int)).tolist(), size.tolist())]
    whole = [k for k, t in enumerate(texts_of) if t in (line * 2).encode()]
    assert len(set(texts_of)) == len(texts_of) and whole and least[whole[0]] == 0
