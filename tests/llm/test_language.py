from __future__ import annotations

import zlib

import numpy as np
import pytest

from colonnade.llm import language
from tests.llm.conftest import SCHEMA, SF, wide


def plain_bundle(text: str, dimensions: int) -> np.ndarray:
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    folded = " ".join(folded.split()) + (" " if folded.endswith(" ") and folded.strip() else "")
    vector = {c: language.letter_vectors(np.array([ord(c)]), dimensions)[0].astype(np.int64) for c in set(folded)}
    total = np.zeros(dimensions, np.int64)
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        total += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return total


def test_against_plain_bundles(docs):
    d = 256
    rows = [r for r in docs.collect() if len(r.text or "") < 4000]
    some = docs.where("length(text) < 4000 or text is null")
    known = language.profiles(some, dimensions=d)
    sums = {}
    for r in rows:
        if r.lang is not None:
            sums[r.lang] = sums.get(r.lang, 0) + plain_bundle(r.text or "", d)
    assert set(known) == set(sums)
    for k, v in sums.items():
        assert np.allclose(known[k], v / np.linalg.norm(v), atol=1e-6)
    names = sorted(known)
    got = {(r.doc_id, r.text): r for r in language.identified(wide(some), known, dimensions=d).collect()}
    for r in rows:
        v = plain_bundle(r.text or "", d)
        cosine = [float(v @ known[k]) / max(np.linalg.norm(v), 1e-9) for k in names]
        found = got[(r.doc_id, r.text)]
        if any(c.isalpha() for c in r.text or ""):
            assert found.lang_pred == names[int(np.argmax(cosine))]
            assert found.score == pytest.approx(min(1, max(0, max(cosine))), abs=1e-4)
        else:
            assert (found.lang_pred, found.score) == ("und", 0)


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.collect()}
    rows = language.language_of(table).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held) > 0


def test_nothing_learned(spark, empty, docs):
    assert language.language_of(empty).count() == 0
    none = spark.createDataFrame([(1, "words", None, "s", 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in language.language_of(none).collect()] == [("und", 0.0)]


def test_characters_above_the_basic_plane(spark):
    """Emoji are no letters; letters of other planes are."""
    gothic, deseret = "\U00010330\U00010331\U00010332\U00010333" * 6, "\U00010400\U00010428\U00010401"
    rows = [(1, "\U0001f600\U0001f601\U0001f602", "en", "s", 3), (2, "plain words of a language here", "en", "s", 1), (3, gothic, "got", "s", 1), (4, "\U0001f600 x", "en", "s", 1)]
    known = language.profiles(spark.createDataFrame(rows[1:3], SCHEMA))
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, SCHEMA), known).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0) and got[4].lang_pred != "und"
    assert got[3].lang_pred == "got" and got[3].score > 0.99
    emoji = language.profiles(spark.createDataFrame([(1, "\U0001f600\U0001f601\U0001f602\U0001f603", "en", "s", 3)], SCHEMA))
    assert emoji == {}
    data = np.frombuffer((deseret + "\n").encode(), np.uint8)
    assert language.folded_texts(data, np.array([0, len(data)]))[0].tolist() == [0x10428, 0x10428, 0x10429, language.END]
