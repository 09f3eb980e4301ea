from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from colonnade.llm import periodic_runs as module
from colonnade.llm.periodic_runs import cycled, periodic_runs, run_digests, word_runs
from tests.llm.conftest import wide

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """Every maximal stretch, period by period; one whose length holds a smaller period twice is that period's."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(all(words[k] == words[k + s] for k in range(i, i + length - s)) for s in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in out)


def plain_row(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    found = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *found, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("least, times", [(6, 4), (4, 2), (2, 2), (9, 3)])
def test_runs_of_random_words(least, times):
    rng = random.Random(7)
    texts = []
    for _ in range(400):
        words: list[int] = []
        while len(words) < rng.randrange(1, 60):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
            words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 50)]
        texts.append(words)
    sizes = np.array([len(t) for t in texts])
    got = word_runs(np.array([w for t in texts for w in t], np.uint64), sizes, least, times)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t, least, times)]


def test_pieces_of_an_ordered_set(monkeypatch):
    monkeypatch.setattr(module, "_PIECE", 4)
    rng = random.Random(3)
    words = [rng.randrange(2) for _ in range(900)] + [1, 0, 0] * 40 + [1] * 300 + [rng.randrange(2) for _ in range(400)]
    got = word_runs(np.array(words, np.uint64), np.array([len(words)]))
    assert list(zip(*(x.tolist() for x in got[1:]), strict=True)) == plain_runs(words)


def test_one_word_many_times():
    got = word_runs(np.zeros(200_000, np.uint64), np.array([200_000]))
    assert [x.tolist() for x in got] == [[0], [0], [200_000], [1]]


def test_equal_hashes_do_not_make_runs(spark, monkeypatch):
    """With one hash for all words, the word-by-word check sends every text to exact numbers."""
    monkeypatch.setattr(module, "range_hashes", lambda buffer, starts, ends: np.zeros(len(starts), np.uint64))
    text = "a b c " * 9 + "d e f g h i j k"
    data = np.frombuffer(text.encode(), np.uint8)
    ((n, runs, kept),) = module._of_slice(data, np.array([0, len(data)]), 0, 1, [None], 6, 4)
    assert (n, [x.tolist() for x in runs], kept) == (35, [[0], [27], [3]], b"a b c d e f g h i j k")


def test_digests_of_the_documents(spark, docs):
    from pyspark.sql import functions as F

    short = docs.where("text is null or length(text) < 20000")
    numbered = wide(short, "_number", "runs", "n_words", "collapsed", "start").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    got = [tuple(r) for r in run_digests(periodic_runs(numbered, number="h")).collect()]
    expect = [plain_row(r.doc_id, r.text) for r in short.collect()]
    assert sorted(got, key=str) == sorted(expect, key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_long_text_in_cycles(spark):
    n, h = 30_000, 10 * 7_005
    a, p = cycled(n, h)
    frame = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)), h)], "doc_id long, text string, h long")
    (row,) = periodic_runs(frame, number="h").collect()
    assert [tuple(r) for r in row.runs] == [(a, n - a, p)]
    assert row.collapsed.split() == [f"w{i}" for i in range(a + p)]


def test_empty(empty):
    assert run_digests(periodic_runs(empty)).count() == 0
