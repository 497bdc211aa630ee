"""Links, order and checks by hand, both routes of ordering, and the query against SQL."""

import json
import random

import pytest

from cohortlib.llm import tool_calls as tc

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, call_id string, content string"
SCHEMAS = {"add": {"a": {"type": "number", "required": True}, "b": {"type": "integer", "minimum": 0}, "mode": {"type": "string", "one_of": ["x", "y"]}}}


def test_links_and_checks(spark):
    calls = [(1, 0, "c1", "add", '{"b": 2, "a": 1.5}', []), (1, 1, "c2", "add", '{"a": "é"}', ["c1"]), (1, 2, "c3", "sub", "{}", None),
             (1, 3, "c4", "add", "{", ["c2", "gone"]), (1, 4, "c5", "add", None, ["c6"]), (1, 5, "c6", "add", '{"a": true}', ["c5"]),
             (1, 0, "c1", "add", '{"b": 2, "a": 1.5}', []), (2, 0, "c1", "add", '{"a": 1, "b": -1}', []), (2, 1, "c2", "add", '{"a": 1, "z": 0}', []),
             (2, 2, "c3", "add", '{"a": 1, "mode": "q"}', []), (None, 0, "c9", "add", "{}", []), (2, 1, None, "add", "{}", [])]
    results = [(1, "c1", "ok"), (1, "c1", "fine"), (1, "c7", 'lone "quoted"\n'), (2, "c2", None), (None, "c1", "x")]
    got = {(r.conv_id, r.call_id): r for r in tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert sorted(got) == [(1, f"c{i}") for i in range(1, 8)] + [(2, f"c{i}") for i in range(1, 4)]
    one = got[1, "c1"]
    assert (one.n_calls, one.n_results, one.valid, one.level, one.position) == (2, 2, True, 0, 0)
    assert one.json == '{"arguments":{"a":1.5,"b":2},"id":"c1","name":"add","result":"fine"}'
    assert {k[1]: (r.error, r.level) for k, r in got.items() if k[0] == 1} == {
        "c1": (None, 0), "c2": ("a: not a number", 1), "c3": ("unknown tool", 0), "c4": ("arguments are not JSON", 2),
        "c5": ("arguments are not an object", None), "c6": ("a: not a number", None), "c7": (None, None)}
    assert got[1, "c7"].json == '{"id":"c7","result":"lone \\"quoted\\"\\n"}' and got[1, "c7"].valid is None
    assert [got[2, f"c{i}"].error for i in (1, 2, 3)] == ["b: too small", "z: unknown field", "mode: not allowed"]
    assert json.loads(got[2, "c2"].json)["result"] is None
    assert [got[1, c].position for c in ("c1", "c3", "c2", "c4")] == [0, 1, 2, 3]


def longest(calls):
    """(conversation, call) -> length of the longest chain of calls it waits for; None in or behind a circle."""
    known = {(c, i): [(c, a) for a in after or []] for c, _, i, _, _, after in calls}
    known = {k: [a for a in v if a in known] for k, v in known.items()}
    level, changed = {}, True
    while changed:
        changed = False
        for k, v in known.items():
            if k not in level and all(a in level for a in v):
                level[k], changed = 1 + max((level[a] for a in v), default=-1), True
    return {k: level.get(k) for k in known}


@pytest.mark.parametrize("large", [10_000, 8, 0])
def test_both_ways_of_ordering(spark, large):
    rnd = random.Random(3)
    calls = []
    for conv in range(6):
        n = rnd.choice((1, 6, 25))
        for i in range(n):
            after = [f"c{rnd.randrange(n + 1)}" for _ in range(rnd.choice((0, 0, 1, 2)))]
            after = [a for a in after if int(a[1:]) < i or conv == 5]                       # the last one may have circles
            calls.append((conv, rnd.randrange(9), f"c{i}", "add", "{}", after))
    got = tc.ordered(spark.createDataFrame(calls, CALLS), large).collect()
    want = {k: v for k, v in longest(calls).items() if v is not None}
    assert {(r.conv_id, r.call_id): r.level for r in got} == want
    turn = {(c, i): t for c, t, i, *_ in calls}
    for conv in range(6):
        mine = sorted((want[k], turn[k], k[1]) for k in want if k[0] == conv)
        assert [r.call_id for r in sorted(got, key=lambda r: r.position) if r.conv_id == conv] == [m[2] for m in mine]
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(len(mine)))


def test_long_chain(spark):
    """One conversation of turns by turns: each call waits for the one two turns before."""
    n = 12_000
    messages = spark.range(2 * n).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "'x' text")
    got = tc.ordered(tc.from_messages(messages)[0], block=2500).collect()
    assert sorted((r.level, r.position) for r in got) == [(i, i) for i in range(n)]
    assert all(r.call_id == f"call-7-{2 * r.level}" for r in got)


@pytest.mark.parametrize("block", [1, 4])
def test_levels_over_block_edges(spark, block):
    rnd = random.Random(5)
    calls = [(conv, rnd.randrange(20), f"c{i}", "add", "{}", [f"c{rnd.randrange(i + (conv == 2))}" for _ in range(rnd.randint(0, 2))] if i else None)
             for conv in range(3) for i in range(12)]
    got = tc.ordered(spark.createDataFrame(calls, CALLS), 0, block).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == {k: v for k, v in longest(calls).items() if v is not None}


def test_plain_conversations(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (1, 3, "assistant", "lone"), (1, 4, "user", None),
            (1, 4, "user", None), (2, 0, "assistant", "early"), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 0, None, "x"), (4, 1, "user", "y" * 1501)]
    messages = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, level int")
    got = {r.call_id: (r.name, r.level, r.n_calls, r.n_results, r.error) for r in tc.link(*tc.from_messages(messages)).collect()}
    assert got == {"call-1-0": ("configure", 0, 1, 0, None), "call-1-1": ("ask", 1, 1, 1, None), "call-1-2": (None, None, 0, 1, None),
                   "call-1-4": ("ask", 0, 2, 0, "text: missing"), "call-2--1": (None, None, 0, 1, None), "call-4-1": ("ask", 0, 1, 0, "text: too long")}


def test_arguments_that_are_hard_to_write(spark):
    deep, flat = "[" * 100_000 + "]" * 100_000, '{"a": 1, "z": "' + "[{" * 5_000 + '"}'
    texts = ['{"a": "\\ud800"}', deep, '{"a": NaN}', '{"a": -Infinity}', '{"a": 1e400}', '{"a": ' + "9" * 5_000 + "}", '{"\\udc00": 1}', flat,
             '{"a": ' + "[" * 199 + "]" * 199 + "}", "", '{"a": 1E2, "b": 12345678901234567890}', '{"a": "\\ud83d\\ude00"}']
    calls = spark.createDataFrame([(1, i, f"c{i:02d}", "add", t, []) for i, t in enumerate(texts)], CALLS)
    got = sorted(tc.link(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect(), key=lambda r: r.turn)
    no = "arguments are not JSON"
    assert [r.error for r in got] == ["a: not a number", no, no, no, no, no, "a: missing", "z: unknown field", "a: not a number", no, None,
                                      "a: not a number"]
    assert [json.loads(r.json, parse_constant=pytest.fail)["arguments"] for r in got if r.error == no] == [t for t in texts if t in
            (deep, '{"a": NaN}', '{"a": -Infinity}', '{"a": 1e400}', texts[5], "")]
    assert got[0].json == '{"arguments":{"a":"\\ud800"},"id":"c00","name":"add"}'
    assert got[6].json.startswith('{"arguments":{"\\udc00":1}')
    assert got[10].json.startswith('{"arguments":{"a":100.0,"b":12345678901234567890}')
    assert "\U0001f600" in got[11].json


def test_empty_tables(spark):
    assert tc.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)).count() == 0
