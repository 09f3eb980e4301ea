from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from colonnade.llm.line_rules import line_frequency_rules
from tests.llm.conftest import wide

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def verdicts(rows, limit, least):
    normal = lambda x: " ".join(WORD.findall(x)).lower()
    seen = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if normal(x):
                seen[(r.source, normal(x))].add((r.doc_id, r.text))
    for r in rows:
        text = r.text or ""
        n = counts(text)
        gone = sum(len(WORD.findall(x)) for x in text.split("\n") if normal(x) and len(seen[(r.source, normal(x))]) > limit)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        yield (r.doc_id, *n, failed, gone, not failed and n[0] - gone >= least * n[0])


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_against_plain_counts(docs, limit):
    got = Counter(tuple(r) for r in line_frequency_rules(wide(docs), limit=limit, least_left=0.8).collect())
    assert got == Counter(verdicts(docs.collect(), limit, 0.8))
    assert limit == 0 or len({k[-1] for k in got}) == 2


def test_copies_are_documents(spark):
    """A document is a doc_id with a text: copies count, repeated rows do not, null ids count once a text."""
    shared = "a line of words that all of these documents hold in the same place"
    own = [(i, f"{shared}\n" + " ".join(f"w{i}x{k}" for k in range(4)), "en", "s", 1) for i in range(2)]
    copies = [(100 + i, f"{shared}\nbelow\n{shared}", "en", "s", 1) for i in range(4)]
    repeated = [(200, f"{shared} again", "en", "s", 1)] * 9 + [(None, f"{shared} again", "en", "s", 1)] * 5
    frame = spark.createDataFrame(own + copies + repeated, "doc_id long, text string, lang string, source string, n_chars long")
    rows = line_frequency_rules(frame, limit=5).collect()
    assert {r.doc_id for r in rows if r.n_line_words_removed} == {0, 1, 100, 101, 102, 103}
    rows = line_frequency_rules(frame, limit=1).collect()
    assert {(r.doc_id, r.n_line_words_removed) for r in rows if r.doc_id in (None, 100, 200)} == {(None, 15), (100, 29), (200, 15)}  # other lines of two documents go too
    assert not any(r.n_line_words_removed for r in line_frequency_rules(frame, limit=6).collect())


def test_counting_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from colonnade.llm import line_rules

    texts = ["some words and other words " * 40 + str(i) for i in range(4000)]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n)), "_host": pa.array(["h"] * n), "_copy": pa.array(range(n)), "_text": pa.array(texts)})
    tracemalloc.start()
    try:
        assert sum(len(b) for b in line_rules._counted(iter([batch]))) == n
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()


def test_empty(empty):
    assert line_frequency_rules(empty).count() == 0
