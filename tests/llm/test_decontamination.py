from __future__ import annotations

import random

import numpy as np
import pytest

from colonnade.llm import decontamination
from tests.llm.conftest import SCHEMA, SF, wide


def normal(text: str | None) -> str:
    out = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalnum() or ord(c) > 0xFFFF else " " for c in text or "")
    return " ".join(out.split(" ")).strip() if "  " not in out else " ".join(out.split())


def distance(passage: str, text: str) -> int:
    """Least edits between the passage and any stretch of the text."""
    a, b = (np.array(list(map(ord, s)), np.int64) for s in (passage, text))
    row, step = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for i, c in enumerate(a):
        new = np.minimum(np.append(i + 1, row[:-1] + (b != c)), row + 1)
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


@pytest.fixture(scope="module")
def items(spark):
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").limit(14).collect()
    more = [(900, "tiny"), (901, None), (902, ""), (903, "A passage of only Thirty chars"), (904, rows[0].text)]
    return spark.createDataFrame([tuple(r) for r in rows] + more, "item_id long, text string")


def edited(rng, text: str, edits: int) -> str:
    for _ in range(edits):
        i, kind = rng.randrange(len(text)), rng.random()
        text = text[:i] + (rng.choice("xyzw") if kind < 0.67 else "") + text[i + (kind > 0.33) :]
    return text


@pytest.fixture(scope="module")
def planted(spark, items, docs):
    rng, rows = random.Random(7), []
    passages = [r.text for r in items.collect() if r.text and len(r.text) > 20]
    for i in range(120):
        p = rng.choice(passages)
        p = edited(rng, p, int(len(p) * rng.choice([0, 0.03, 0.08, 0.1, 0.12, 0.2])))
        p = rng.choice([p, p.upper(), p.replace(" ", "  -\n"), p[: len(p) // 2]])
        rows.append((50_000 + i, f"{'Some words before. ' * rng.randint(0, 3)}{p}{' and after' * rng.randint(0, 3)}", "en", "s", 1))
    small = docs.where("length(text) < 2500 or text is null").limit(60)
    return small.unionByName(docs.where("doc_id > 9000 or doc_id is null")).unionByName(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("indexed", [4_000_000, 900])
def test_against_full_alignment(planted, items, monkeypatch, indexed):
    monkeypatch.setattr(decontamination, "INDEXED", indexed)
    got = decontamination.contaminated(wide(planted), items).collect()
    assert len(got) == planted.count()
    expect = {}
    passages = [(r.item_id, normal(r.text)) for r in items.collect()]
    for r in planted.collect():
        text = normal(r.text)
        if len(text) > 50_000:
            continue
        found = set()
        for k, p in passages:
            if len(p) >= 8 and distance(p, text) <= min(int(len(p) * 0.1), (len(p) - 8) // 8):
                found.add(k)
        expect.setdefault(r.doc_id, set()).update(found)
    for r in got:
        if r.doc_id in expect and r.doc_id is not None:
            assert {m.item for m in r.matches} == expect[r.doc_id], r.doc_id
            assert r.contaminated == bool(r.matches) and r.n_passages == len({m.item for m in r.matches})
    assert 20 < sum(r.contaminated for r in got) < len(got)


def test_spans_name_the_passage(spark, items):
    passage = items.first().text
    docs = spark.createDataFrame([(1, f"Ünrelated: {passage.upper()} tail {passage}", "en", "s", 1)], SCHEMA)
    row = decontamination.contaminated(docs, items.limit(1)).first()
    text = f"Ünrelated: {passage.upper()} tail {passage}"
    assert [normal(text[m.start : m.stop]) for m in row.matches] == [normal(passage)] * 2
    assert [m.edits for m in row.matches] == [0, 0]


def test_empty(empty, items, docs):
    assert decontamination.contaminated(empty, items).count() == 0
    assert not any(r.contaminated for r in decontamination.contaminated(docs, items.where("item_id < 0")).collect())


def test_candidates_of_all_lengths_are_aligned_together():
    rng = random.Random(5)
    passages = [(i, "".join(rng.choice("abcdefg ") for _ in range(n)).strip()) for i, n in enumerate((9, 17, 40, 120, 300, 900))]
    index = decontamination.PassageIndex(passages, 8, 0.1)
    texts = [f"{edited(rng, p, k * len(p) // 30)} and more {p}" for _, p in passages for k in (0, 1, 2)] + [p for _, p in passages]
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    together = decontamination.passages_in(data, at, 0, len(texts), index)
    alone = [found for i in range(len(texts)) for found in decontamination.passages_in(data, at, i, i + 1, index)]
    assert together == alone and {f[1] for f in together} == set(range(6))
    for row, item, start, stop, edits in together:
        assert distance(normal(passages[item][1]), normal(texts[row][start:stop])) == edits
