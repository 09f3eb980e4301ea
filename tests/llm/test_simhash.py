from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from colonnade.llm import simhash
from colonnade.llm.components import component_roots
from tests.llm.conftest import SCHEMA, wide


def plain_fingerprint(text: str | None) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items: list[tuple[int | None, int]]) -> dict[int, int | None]:
    """Smallest id by fingerprint."""
    prints = list({p for _, p in items})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                root[find(p)] = find(q)
    ids = {}
    for d, p in items:
        ids.setdefault(find(p), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return {p: least[find(p)] for p in prints}


def test_against_plain_components(docs):
    rows = docs.collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    ids = plain_components(prints)
    expect = Counter((d, p, ids[p]) for d, p in prints)
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(wide(docs)).collect())
    assert got == expect
    assert len(set(ids.values())) < len(ids)


@pytest.mark.parametrize("long_list", [2048, 3])
def test_no_link_is_lost(spark, monkeypatch, long_list):
    """Clusters of fingerprints that differ in up to four bits anywhere, also through long posting lists."""
    rng = np.random.default_rng(3)
    values = set()
    for _ in range(40):
        p = int(rng.integers(0, 2**63))
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                p ^= 1 << int(bit)
            values.add(p)
    values = sorted(values)
    fp = np.array(values, np.uint64)
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    lists = simhash._indexed(4)
    import pyarrow as pa

    simhash_links = set()
    by_part = {}
    for b in lists([pa.RecordBatch.from_pydict({"fp": fp.view(np.int64)})]):
        for part, e in zip(b.column("part").to_pylist(), b.column("entries").to_pylist(), strict=True):
            by_part.setdefault(part, []).append(e)
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    for e in by_part.values():
        for b in simhash._linked([pa.RecordBatch.from_pydict({"part": [0] * len(e), "entries": pa.array(e, pa.binary())})]):
            simhash_links |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
    links = spark.createDataFrame(sorted(simhash_links), "a long, b long")
    roots = {r.node: r.root for r in component_roots(links).collect()}
    want = plain_components([(k, v) for k, v in enumerate(values)])
    group = lambda named: Counter(Counter(named).values())
    got = {v: roots.get(int(np.array([v], np.uint64).view(np.int64)[0]), int(np.array([v], np.uint64).view(np.int64)[0])) for v in values}
    assert group(got.values()) == group(want.values())
    pairs = {}
    for v in values:
        pairs.setdefault(want[v], set()).add(got[v])
    assert all(len(s) == 1 for s in pairs.values())
    assert table.count() == len(values)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (500, 500)], "a long, b long")
    roots = {r.node: r.root for r in component_roots(links).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {500: 400}


def test_empty(empty):
    assert simhash.simhash_components(empty).count() == 0


def test_one_row_of_each_component_stays(docs):
    given = wide(docs.unionByName(docs.where("doc_id in (9004, 9008) or doc_id is null")), "_row", "_id", "root", "first", "copy")
    rows = given.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    label = plain_components(list(enumerate(prints)))  # by place, so that null ids are told apart
    groups: dict = {}
    for p, r in zip(prints, rows, strict=True):
        groups.setdefault(label[p], []).append(r)
    got = simhash.one_of_each_component(given).collect()
    assert len(got) == len(groups)
    last = 2**63 - 1
    order = lambda r: last if r.doc_id is None else r.doc_id
    assert sorted(map(order, got)) == sorted(min(map(order, g)) for g in groups.values())
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}


def test_one_row_of_a_repeated_one(spark):
    frame = spark.createDataFrame([(None, "the same row again and again", "en", "s", 1)] * 5000, SCHEMA)
    assert simhash.one_of_each_component(frame.repartition(4)).count() == 1
    assert simhash.one_of_each_component(frame.limit(0)).count() == 0
