from __future__ import annotations

import json
import random

import pytest

from colonnade.llm import tool_calls
from tests.llm.conftest import SF

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}


@pytest.mark.parametrize("together", [20_000, 1])
def test_levels(spark, monkeypatch, together):
    monkeypatch.setattr(tool_calls, "TOGETHER", together)
    rng, rows, expect = random.Random(4), [], {}
    for conv in (None, 1, 2, 3):
        needs = {f"c{i}": [f"c{j}" for j in range(i) if rng.random() < 0.3] + ["gone"] for i in range(8)}
        if conv == 2:
            needs["c3"].append("c6")
            needs["c6"].append("c3")
        rows += [(conv, 1, c, "add", "{}", d) for c, d in needs.items()]

        def level(c, seen=(), needs=needs):
            if c in seen:
                raise RecursionError
            return max((level(d, (*seen, c)) + 1 for d in needs[c] if d in needs), default=0)

        for c in needs:
            try:
                expect[(conv, c)] = level(c)
            except RecursionError:
                expect[(conv, c)] = None
    got = tool_calls.call_levels(spark.createDataFrame(rows, CALLS).select("conv_id", "call_id", "needs")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == expect and len(got) == len(rows)


def test_links_errors_and_json(spark):
    calls = [
        (1, 1, "a", "add", '{"x": 1, "tags": ["ü"]}', None),
        (1, 3, "b", "add", '{"tags": [1], "y": true, "x": -1}', ["a"]),
        (1, 5, "b", "add", "{}", []),
        (1, 6, "c", "other", "{}", ["b"]),
        (None, 1, "a", "add", "not json", []),
        (1, 9, None, "add", None, []),
        (2, 4, "e", "add", '{"x": 3}', []),
    ]
    results = [(1, 2, "a", "4"), (1, 4, "a", "5"), (1, 7, "z", None), (2, 3, "e", "early"), (None, 2, None, "x")]
    rows = tool_calls.linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    got = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert len(rows) == len(got) == 8
    a = got[(1, "a", 1)]
    assert (a.status, a.level, a.n_calls, a.n_results, a.errors) == ("linked", 0, 1, 2, [])
    assert a.json == '{"arguments":{"tags":["ü"],"x":1},"id":"a","name":"add","result":"4"}'
    b = got[(1, "b", 3)]
    assert (b.status, b.level, b.n_calls) == ("open", 1, 2)
    assert b.errors == ["$.tags[0]: not string", "$.x: below minimum", "$.y: unknown"]
    assert got[(1, "c", 6)].errors == ["$: no such tool"] and got[(1, "c", 6)].level == 2
    assert got[(None, "a", 1)].errors == ["$: not JSON"]
    assert got[(1, "z", 7)].status == "orphan" and got[(2, "e", 4)].status == "early"
    assert got[(1, None, 9)].status == got[(None, None, 2)].status == "unnamed"


def test_arguments_that_have_no_canonical_form(spark):
    odd = {"far": '{"x": 1e999}', "deep": "[" * 100_000, "nested": '{"x": ' * 3000 + "1" + "}" * 3000, "half": '{"x": "\\ud800"}', "nan": '{"x": NaN}', "digits": '{"x": ' + "9" * 5000 + "}", "none": None}
    calls = [(1, i, k, "add", v, []) for i, (k, v) in enumerate(odd.items())] + [(1, 99, "fine", "add", '{"x": 1}', [])]
    rows = tool_calls.linked_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    got = {r.call_id: r for r in rows}
    assert set(got) == {*odd, "fine"} and got["fine"].errors == []
    assert {k: r.errors for k, r in got.items() if k in ("far", "half")} == {"far": ["$: no canonical form"], "half": ["$: no canonical form"]}
    assert all(got[k].errors for k in odd)
    for k, v in odd.items():
        assert json.loads(got[k].json).get("arguments") == (json.loads(v) if k == "nested" else v)


def test_every_turn_gives_a_row(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "tool", "c"), (1, 3, None, "d"), (1, None, "user", "e"), (None, None, None, None)]
    messages = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = tool_calls.linked_calls(*tool_calls.conversation_calls(messages), tool_calls.CONVERSATION_TOOLS).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.status) for r in rows) == sorted(
        [("1", "0", "linked"), ("1", "2", "unnamed"), ("1", "3", "unnamed"), ("1", "None", "unnamed"), ("None", "None", "unnamed")]
    )


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """3000 calls in a chain, a fan at its end, a ring, and calls above the ring."""
    monkeypatch.setattr(tool_calls, "TOGETHER", 10)
    taken, cut = [], tool_calls.cut
    monkeypatch.setattr(tool_calls, "cut", lambda df: taken.append(1) or cut(df))
    n = 3000
    rows = [(1, 1, f"c{i}", "add", "{}", [f"c{i - 1}"] if i else []) for i in range(n)]
    rows += [(1, 1, "top", "add", "{}", ["c7", f"c{n - 1}", "gone"]), (1, 1, "above", "add", "{}", ["top"])]
    rows += [(1, 1, f"r{i}", "add", "{}", [f"r{(i + 1) % 3}"]) for i in range(3)] + [(1, 1, "onring", "add", "{}", ["r0"]), (1, 1, "both", "add", "{}", ["onring", "c0"])]
    got = {r.call_id: r.level for r in tool_calls.call_levels(spark.createDataFrame(rows, CALLS).select("conv_id", "call_id", "needs")).collect()}
    assert got == {f"c{i}": i for i in range(n)} | {"top": n, "above": n + 1} | dict.fromkeys(["r0", "r1", "r2", "onring", "both"])
    assert len(taken) < 50


def test_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = tool_calls.linked_calls(*tool_calls.conversation_calls(table), tool_calls.CONVERSATION_TOOLS).collect()
    turns = {(r.conv_id, r.turn): r for r in table.collect()}
    calls = {k for k, r in turns.items() if r.role in ("user", "system")}
    answered = {k for k in calls if turns.get((k[0], k[1] + 1)) and turns[(k[0], k[1] + 1)].role == "assistant"}
    assert {(r.conv_id, r.turn) for r in rows if r.status in ("linked", "open")} == calls
    assert {(r.conv_id, r.turn) for r in rows if r.status == "linked"} == answered
    for r in rows:
        message = json.loads(r.json)
        assert r.json == tool_calls.canonical(message)
        if r.status == "linked":
            assert message["result"] == turns[(r.conv_id, r.turn + 1)].text


def test_empty(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert tool_calls.linked_calls(calls, results, SCHEMAS).count() == 0
