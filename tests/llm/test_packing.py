from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from colonnade.llm import packing
from tests.llm.conftest import wide


def plain(size, source, cluster, capacity):
    bins, out = [], []
    for s, a, c in zip(size, source, cluster, strict=True):
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= s and a not in b["a"] and c not in b["c"]]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "a": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= s
        bins[i]["a"] |= {a} - {-1}
        bins[i]["c"] |= {c} - {-1}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_matches_the_plain_search(seed):
    rng = np.random.default_rng(seed)
    n = 600
    size = np.sort(rng.integers(1, 100, n))[::-1]
    source, cluster = rng.integers(-1, 90, n), rng.integers(-1, 150, n)
    sequence, offset = packing.best_fit(size, source, cluster, 100)
    assert list(zip(sequence.tolist(), offset.tolist(), strict=True)) == plain(size.tolist(), source.tolist(), cluster.tolist(), 100)


@pytest.mark.parametrize("group", [10_000, 30])
def test_every_token_is_placed_once(docs, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rows = packing.packed(wide(docs), capacity=512).collect()
    texts = docs.collect()
    tokens = defaultdict(int)
    for r in texts:
        tokens[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1
    placed = defaultdict(int)
    for r in rows:
        placed[r.doc_id] += r.n_tokens
    assert placed == tokens
    by_id = {r.doc_id: r for r in texts}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and sum(r.n_tokens for r in own) <= 512
        assert all(a.offset + a.n_tokens == b.offset for a, b in zip(own, own[1:]))
        sources = [by_id[r.doc_id].source for r in own if r.doc_id is not None and by_id[r.doc_id].source is not None]
        assert len(sources) == len(set(sources))
        words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", (by_id[r.doc_id].text or "").lower())) for r in own if r.doc_id is not None]
        assert len(words) == len(set(words))


def test_given_clusters(docs):
    from pyspark.sql import functions as F

    rows = packing.packed(docs.withColumn("near", F.col("doc_id") % 3).withColumn("source", F.lit(None).cast("string")), cluster="near").collect()
    bins = defaultdict(list)
    for r in rows:
        if r.n_tokens < packing.CAPACITY and r.doc_id is not None:
            bins[r.sequence].append(r.doc_id % 3)
    assert all(len(v) == len(set(v)) for v in bins.values())


def test_empty(empty):
    assert packing.packed(empty).count() == 0
