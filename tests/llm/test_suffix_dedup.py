from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from colonnade.llm import suffix_dedup
from colonnade.llm.collection_bwt import suffix_groups
from tests.llm.conftest import SCHEMA, wide


def plain(rows, length: int):
    """Removed bytes by looking every string up in a dictionary of first documents."""
    last = 2**63 - 1
    first: dict[bytes, int] = {}
    items = [(last if r.doc_id is None else r.doc_id, r.doc_id, (r.text or "").encode()) for r in rows]
    for order, _, b in items:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, last), order)
    for order, doc_id, b in items:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order:
                gone[i] += 1
                if i + length < len(gone):
                    gone[i + length] -= 1
        covered = np.cumsum(gone)[: len(b)] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], covered.astype(int)))) == 1))
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        yield (doc_id, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_groups_of_equal_strings():
    rng = random.Random(5)
    for least in (3, 6):
        texts = ["".join(rng.choice("ab\0") for _ in range(rng.randint(least, 2 * least))).encode() for _ in range(200)]
        size = np.array([len(t) for t in texts])
        numbers, begin = suffix_groups(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, least)
        strings = [t[k : k + least] for t in texts for k in range(len(t) - least + 1)]
        assert begin[-1] == len(strings) == len(numbers)
        pairs = set(zip(numbers.tolist(), strings, strict=True))
        assert len(pairs) == len(set(numbers.tolist())) == len(set(strings))


@pytest.fixture(scope="module")
def mingled(spark, docs):
    """The small table with passages that start, end, cross and repeat anywhere."""
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcdefg hé") for _ in range(rng.randint(30, 160))) for _ in range(12)]
    rows = []
    for i in range(160):
        text = "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("xyz uvw") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(1, 7)))
        rows.append((20_000 + rng.randint(0, 120), text, "en", "s", len(text)))
    rows += [(30_000 - i, "same text, longer than the least length of a string to remove", "en", "s", 1) for i in range(5)]
    return docs.unionByName(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_lookup(mingled, monkeypatch, small):
    if small:  # many blocks and parts, divided collections, strides inside texts
        for name, value in {"BLOCK": 40_000, "PART": 30_000, "CONTEXTS": 40, "STRIDE": 1000}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    got = Counter(tuple(r) for r in suffix_dedup.removed_digests(wide(mingled)).collect())
    assert got == Counter(plain(mingled.collect(), 50))


def test_spans_and_kept_bytes(mingled):
    given = Counter((r.doc_id, (r.text or "").encode()) for r in mingled.collect())
    texts = {}
    for (doc_id, text), n in given.items():
        texts.setdefault(doc_id, []).append(text)
    rows = suffix_dedup.removed_repeats(wide(mingled)).collect()
    assert len(rows) == sum(given.values())
    for r in rows:
        runs = list(zip(r.starts, r.lengths, strict=True))

        def without(text):
            for s, n in reversed(runs):
                text = text[:s] + text[s + n :]
            return text

        assert any(len(t) == r.n_bytes and without(t) == bytes(r.kept) for t in texts[r.doc_id])


@pytest.mark.parametrize("small", [False, True])
def test_remaining_rows_stay_whole(mingled, monkeypatch, small):
    if small:
        for name, value in {"BLOCK": 40_000, "PART": 30_000, "CONTEXTS": 40}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    from pyspark.sql import functions as F

    clashing = ("_key", "_id", "_first", "starts", "lengths", "_lost", "_row", "_block")
    frame = wide(mingled, *clashing).withColumn("starts", F.concat(F.lit("n"), F.col("n_chars").cast("string")))
    given = frame.collect()
    expect = Counter()
    for row, (_, n, gone, _, digest) in zip(given, plain(given, 50), strict=True):
        if not gone:
            expect[tuple(row)] += 1
    got = suffix_dedup.without_repeats(frame).collect()
    digests = {(d, k) for d, _, gone, _, k in plain(given, 50) if gone}
    changed = [r for r in got if tuple(r) not in expect]
    assert Counter(tuple(r) for r in got if tuple(r) in expect) == expect
    assert changed and all(r.text.split() and r.starts in (None, f"n{r.n_chars}") for r in changed)
    whole = [r for r in changed if r.text.isascii()]
    assert whole and sum((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) in digests for r in whole) > 0.9 * len(whole)


def test_empty(empty):
    assert suffix_dedup.without_repeats(empty).count() == 0
    assert suffix_dedup.removed_digests(empty).count() == 0
    assert suffix_dedup.removed_repeats(empty).count() == 0
