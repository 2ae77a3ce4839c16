import json

import random

import pytest

from remedia.llm.chat import DEPTH, canonical, levels, link, problems, read

SCHEMAS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False,
                 "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}}}}}
CALL = "call_id string, name string, arguments string"


def test_problems():
    assert not problems({"a": 1, "b": ["x"]}, SCHEMAS["f"])
    for bad in ({}, {"a": 0}, {"a": True}, {"a": "1"}, {"a": 1, "b": [2]}, {"a": 1, "c": 0}):
        assert problems(bad, SCHEMAS["f"])
    assert problems("x", {"enum": ["y"]}) and problems("abc", {"maxLength": 2}) and problems(3, {"maximum": 2})


def test_canonical():
    assert canonical({"b": 1.0, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1.0}'


def test_levels(spark):
    calls = spark.createDataFrame([(c, "f", "{}") for c in "abcdexyz"] + [("a", "f", "{}"), (None, "f", "{}")], CALL)
    needs = spark.createDataFrame(
        [("b", "a"), ("c", "b"), ("c", "a"), ("d", "nowhere"), ("x", "y"), ("y", "x"), ("z", "x"), (None, "a"), ("b", None), ("b", "a")],
        "call_id string, needs string")
    got = {r.call_id: r.level for r in levels(calls, needs).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0}


def test_link(spark):
    calls = spark.createDataFrame(
        [("1", "f", '{"b": ["x"], "a": 2}'), ("2", "f", '{"a":0}'), ("3", "g", "{}"), ("4", "f", "not json"), ("5", "f", None),
         (None, "f", '{"a":1}'), ("1", "f", '{"a":1}')], CALL).selectExpr("*", "7 AS extra")
    results = spark.createDataFrame([("1", 2, "late"), ("1", 1, "early"), (None, 1, "lost"), ("9", 1, "alone"), ("2", 1, None)],
                                    "call_id string, result_order int, content string")
    needs = spark.createDataFrame([("2", "1")], "call_id string, needs string")
    rows = link(calls, results, needs, SCHEMAS).collect()
    assert len(rows) == 7 and all(r.extra == 7 for r in rows)
    first = next(r for r in rows if r.call_id == "1" and "x" in r.arguments)
    assert (first.n_results, first.result, first.level, first.valid) == (2, "early", 0, True)
    assert json.loads(first.message) == {"arguments": {"a": 2, "b": ["x"]}, "id": "1", "name": "f", "result": "early"}
    assert {r.call_id: r.valid for r in rows if r.call_id in ("2", "3", "4", "5")} == dict.fromkeys("2345", False)
    assert next(r for r in rows if r.call_id == "2").level == 1
    assert next(r for r in rows if r.call_id is None).n_results == 0
    assert link(calls.limit(0), results, needs, SCHEMAS).count() == 0


@pytest.mark.parametrize("text", [
    "[" * 20_000 + "]" * 20_000, '{"a":' * 20_000 + "1" + "}" * 20_000, '{"a":1e999}', '{"a":-1e999}', '{"a":NaN}',
    '{"a":Infinity}', '{"a":"\\ud800"}', '{"\\udfff":1}', '{"a":[{"b":"x\\udc00"}]}', '{"a":' + "9" * 5000 + "}", "", " ", "null",
    "[]", '"x"', None, '{"a":' + "[" * DEPTH + "]" * DEPTH + "}"])
def test_unsound_arguments_are_no_object(text):
    assert read(text) is None


def test_sound_arguments():
    assert read('{"a":"\\ud83d\\ude00","b":1e300}') == {"a": "\U0001f600", "b": 1e300}
    deep = '{"a":' + "[" * (DEPTH - 1) + "]" * (DEPTH - 1) + "}"
    assert canonical(read(deep)) == deep


def test_link_survives_any_text_and_clashing_columns(spark):
    bad = ["[" * 20_000, '{"a":1e999}', '{"a":"\\ud800"}', "x" * 300_000, None, '{"a":NaN}']
    calls = spark.createDataFrame([(str(i), "f", t, 2**53 + 1 if i else None) for i, t in enumerate(bad)], CALL + ", turn long")
    calls = calls.selectExpr("*", "'own' AS level", "1 AS n_results", "2 AS valid", "'m' AS message", "'r' AS result", "'k' AS _first")
    results = spark.createDataFrame([("1", 1, "y" * 300_000)], "call_id string, result_order int, content string")
    needs = spark.createDataFrame([], "call_id string, needs string")
    rows = {r.call_id: r for r in link(calls, results, needs, SCHEMAS).collect()}
    assert len(rows) == 6 and not any(r.valid for r in rows.values())
    assert all(r.level == 0 and r._first == "k" for r in rows.values())
    assert rows["0"].turn is None and {r.turn for c, r in rows.items() if c != "0"} == {2**53 + 1}
    for i, text in enumerate(bad):
        assert json.loads(rows[str(i)].message)["arguments"] == text
    assert len(rows["1"].result) == 300_000 and rows["1"].n_results == 1


def test_levels_match_brute_force_on_random_graphs(spark):
    rng = random.Random(5)
    nodes = list(range(60))
    edges = [(a, b) for a in nodes for b in rng.sample(nodes, 2) if b < a or rng.random() < 0.03] + [(i, i - 1) for i in range(50, 60)]
    want, left = {}, set(nodes)
    for level in range(len(nodes)):
        ready = {n for n in left if not any(a == n and b in left for a, b in edges)}
        if not ready:
            break
        want |= dict.fromkeys(ready, level)
        left -= ready
    calls = spark.createDataFrame([(str(n), "f", "{}") for n in nodes], CALL)
    got = levels(calls, spark.createDataFrame([(str(a), str(b)) for a, b in edges], "call_id string, needs string"))
    assert {int(r.call_id): r.level for r in got.collect()} == want
