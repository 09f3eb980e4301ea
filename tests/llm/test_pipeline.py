from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import SF, wide
from tests.llm.test_decontamination import normal
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import plain


@pytest.fixture(scope="module")
def outputs(spark, docs, tmp_path_factory):
    """The rows before and after each stage; every result is written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), [docs.collect()]
    frame = wide(docs, "_key", "_id", "kept_", "starts", "_d", "_c", "score", "lang_pred")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF).write.parquet(str(folder / name))
        frame = spark.read.parquet(str(folder / name))
        out.append(frame.collect())
    return out


def test_language_keeps_prose(outputs, spark):
    before, after = outputs[0], {r.doc_id for r in outputs[1]}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert clean & {r.doc_id for r in before} <= after
    assert not {9001, 9002, 9003} & after
    given = {(r.doc_id, r.text) for r in before}
    assert all((r.doc_id, r.text) in given for r in outputs[1])


def test_one_of_each_group_stays(outputs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in outputs[1]]
    ids = plain_components(rows)
    groups = {i for i in ids.values() if i is not None}
    assert sorted(r.doc_id for r in outputs[2] if r.doc_id is not None) == sorted(groups)


def test_repeats_go(outputs):
    expect = {d: (n, gone) for d, n, gone, _, _ in plain(outputs[2], 50)}
    after = {r.doc_id: r for r in outputs[3]}
    for r in outputs[2]:
        n, gone = expect[r.doc_id]
        if not gone:
            assert after[r.doc_id].text == r.text
        elif r.doc_id in after:
            assert n - gone - 6 * n // 50 - 6 <= len(after[r.doc_id].text.encode()) <= n - gone
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert n - gone < 200


def test_leaks_go_and_the_rest_stays(outputs, spark):
    passages = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in outputs[4]}
    held = {r.doc_id for r in outputs[3] if any(p in normal(r.text) for p in passages)}
    assert held and not held & kept
    assert len(outputs[3]) - len(outputs[4]) <= 1.2 * len(held) + 1


def test_all_that_is_left_is_packed(outputs):
    placed = defaultdict(int)
    for r in outputs[5]:
        placed[r.doc_id] += r.n_tokens
    assert {k: v - 1 for k, v in placed.items()} == {r.doc_id: len(r.text.split()) for r in outputs[4]}


def test_run_is_the_stages(outputs, spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) > 0


def test_empty(spark, empty):
    frame = empty
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0
