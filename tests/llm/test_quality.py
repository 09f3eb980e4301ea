from __future__ import annotations

import zlib

import numpy as np
import pytest

from colonnade.llm import quality
from tests.llm.conftest import SF, wide


def test_word_vectors_match_plain_sums(docs):
    some = docs.where("length(text) < 1500 or text is null").limit(40)
    fixed, total = quality.fixed_vectors(), np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for r in some.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        bucket, _ = quality.tokens_of(raw, np.array([0, len(raw)]), 0, 1)
        for i, b in enumerate(bucket):
            for k in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= k < len(bucket):
                    total[b] += fixed[bucket[k]]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(wide(some)), total + fixed / np.sqrt(quality.SIGNS), atol=1e-4)


def test_frequent_words_are_summed_piece_by_piece(monkeypatch):
    """Sums of four signs run in 16 bits, so a bucket's rows are added in bounded pieces; the sums do not change."""
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"_text": ["", "same " * 30_000, "one Two two same\n##", "x", " "]})
    (whole,) = quality._contexts(iter([texts]))
    found = np.concatenate([np.frombuffer(r, np.float32) for r in whole.column("sums").to_pylist()]).reshape(quality.BUCKETS, -1)
    plain, fixed = np.zeros_like(found), quality.fixed_vectors()
    for raw in (np.frombuffer(t.encode(), np.uint8) for t in texts.column("_text").to_pylist()):
        bucket, _ = quality.tokens_of(raw, np.array([0, len(raw)]), 0, 1)
        for k in (1, 2):
            np.add.at(plain, bucket[k:], fixed[bucket[:-k]])
            np.add.at(plain, bucket[:-k], fixed[bucket[k:]])
    assert np.array_equal(found, plain)
    monkeypatch.setattr(quality, "_ROWS", 3)
    (pieces,) = quality._contexts(iter([texts]))
    assert pieces.equals(whole)


def test_slices_do_not_change_the_pooling():
    texts = [b"One two, TWO two!! ### x", b"", b"  ", "é É ÀB cd".encode(), b"12 ab34 ** "]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    vectors = quality.fixed_vectors()
    together = quality.pooled(data, at, 0, len(texts), vectors)
    for i, t in enumerate(texts):
        alone = quality.pooled(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 0, 1, vectors)
        assert np.allclose(alone[0], together[i], atol=1e-6)


def test_held_out_accuracy(spark):
    sf = f"{SF[:-5]}0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_of(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    right = np.mean([p == t for _, p, t in held])
    calibration = abs(np.mean([s for s, _, _ in held]) - np.mean([t for _, _, t in held]))
    print("held out", len(held), right, calibration)
    assert right > 0.97 and calibration < 0.03


def test_one_class_and_no_rows(spark, docs, empty):
    labels = spark.createDataFrame([(9004, 1, 0), (9005, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_of(docs, labels).collect()
    assert len(rows) == docs.count() and {r.predicted for r in rows} == {1}
    assert quality.quality_of(empty, labels).count() == 0
    assert {r.score for r in quality.quality_of(docs, labels.where("doc_id < 0")).collect()} == {0.5}
