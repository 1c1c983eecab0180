import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import toolcalls

SCHEMAS = {
    "search": {
        "properties": {
            "q": {"type": "string", "minLength": 2, "maxLength": 5},
            "k": {"type": "integer", "minimum": 1, "maximum": 9},
            "m": {"enum": ["a", "b"]},
            "o": {"type": "object"},
            "l": {"type": "array"},
            "f": {"type": "number"},
            "t": {"type": "boolean"},
        },
        "required": ["q"],
        "additionalProperties": False,
    }
}
SCHEMA = "conv_id string, turn long, role string, text string"


def call(identifier, arguments, after=None, name="search"):
    return {"id": identifier, "name": name, "after": after, "arguments": arguments}


def message(conversation, turn, *calls):
    return (conversation, turn, "assistant", json.dumps({"tool_calls": list(calls)}))


def result(conversation, turn, identifier, content):
    return (conversation, turn, "tool", json.dumps({"tool_call_id": identifier, "content": content}))


def linked(spark, rows):
    """Rows by conversation and identifier; of an identifier used again, the first."""
    got = toolcalls.link_calls(spark.createDataFrame(rows, SCHEMA), SCHEMAS).where("status <> 'message'").collect()
    out = {}
    for r in sorted(got, key=lambda r: r["position"]):
        out.setdefault((r["conv_id"], r["id"]), r)
    return out


@pytest.mark.parametrize(
    "arguments, problems",
    [
        ({"q": "abc"}, []),
        ({"q": "abc", "k": 3, "m": "a", "o": {"z": 1}, "l": [1], "f": 1.5, "t": True}, []),
        ({}, ["q: missing"]),
        ({"q": None}, ["q: not a string"]),
        ({"q": "a"}, ["q: too short"]),
        ({"q": "abcdef"}, ["q: too long"]),
        ({"q": "abc", "k": 2.5}, ["k: not a integer"]),
        ({"q": "abc", "k": 0}, ["k: too small"]),
        ({"q": "abc", "k": 10}, ["k: too large"]),
        ({"q": "abc", "m": "c"}, ["m: not allowed"]),
        ({"q": "abc", "o": [], "l": {}}, ["o: not a object", "l: not a array"]),
        ({"q": "abc", "f": "1", "t": 1}, ["f: not a number", "t: not a boolean"]),
        ({"q": "abc", "y": 1, "x": 2}, ["unknown: x, y"]),
        ([1], ["arguments: not an object"]),
    ],
)
def test_schema(spark, arguments, problems):
    row = linked(spark, [message("a", 0, call("1", arguments))])["a", "1"]
    assert row["problems"] == problems and row["valid"] == (not problems)


def test_links_order_and_json(spark):
    rows = [
        message("a", 0, call("1", {"q": "abc", "k": 1}), call("2", {"k": 2, "q": "xyz"}, "1")),
        result("a", 1, "2", 'x "y" é\n'),
        result("a", 2, "9", "nobody asked"),
        message("a", 3, call("3", {"q": "abc"}, "2", "fly")),
        message("b", 0, call("1", {"q": "abc"}, "77")),
        ("a", 4, "assistant", "not json"),
        ("a", 5, "assistant", None),
        ("a", 6, None, "{}"),
        (None, 0, "assistant", rows_text()),
        message("a", 7, call("1", {"q": "later"})),
        result("a", 8, "2", "later"),
    ]
    got = linked(spark, rows)
    assert {k: (r["status"], r["depth"], r["turn"], r["result_turn"]) for k, r in got.items()} == {
        ("a", "1"): ("unanswered", 0, 0, None),
        ("a", "2"): ("linked", 1, 0, 1),
        ("a", "3"): ("unanswered", 2, 3, None),
        ("a", "9"): ("orphan", None, None, 2),
        ("b", "1"): ("unanswered", 0, 0, None),
    }
    assert got["a", "2"]["json"] == '{"after":"1","arguments":{"k":2,"q":"xyz"},"conversation":"a","id":"2","name":"search","result":"x \\"y\\" é\\n"}'
    assert got["a", "3"]["problems"] == ["unknown tool"] and got["b", "1"]["problems"] == ["after: unknown call"]
    for r in got.values():
        parsed = json.loads(r["json"])
        assert r["json"] == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def brute_links(rows):
    """Walk each conversation in order: (conversation, id, status, turn, result_turn) of calls, results and messages."""
    out, last = [], {}
    for conversation, turn, role, text in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        try:
            parsed = json.loads(text) if text and conversation is not None else {}
        except ValueError:
            parsed = {}
        calls = parsed.get("tool_calls", []) if role == "assistant" else []
        answer = parsed.get("tool_call_id") if role == "tool" else None
        for c in calls:
            entry = [conversation, c["id"], "unanswered", turn, None]
            out.append(entry)
            if c["id"] is not None:
                last[conversation, c["id"]] = entry
        if answer is not None:
            entry = last.get((conversation, answer))
            if entry is None:
                out.append([conversation, answer, "orphan", None, turn])
            elif entry[2] == "linked":
                out.append([conversation, answer, "repeated", None, turn])
            else:
                entry[2], entry[4] = "linked", turn
        elif not calls:
            out.append([conversation, None, "message", turn, None])
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_call_result_and_message_has_a_row(spark, seed):
    chance = random.Random(seed)
    rows = [("a", -1, "system", "be kind"), ("a", 999, None, None), (None, 0, "assistant", rows_text()), ("b", 0, "assistant", '{"tool_calls": []}')]
    for conversation in "abc":
        for turn in range(chance.randrange(20, 60)):
            identifier = chance.choice(["call_0", "call_1", None])
            if chance.random() < 0.5:
                calls = [call(chance.choice(["call_0", "call_1", "call_2", None]), {"q": "abc"}, chance.choice([None, "call_0"])) for _ in range(chance.randrange(1, 4))]
                rows.append(message(conversation, turn + 1, *calls))
            elif chance.random() < 0.8:
                rows.append(result(conversation, turn + 1, identifier, "x" * turn))
            else:
                rows.append((conversation, turn + 1, "user", f"text {turn}"))
    found = toolcalls.link_calls(spark.createDataFrame(rows, SCHEMA).repartition(3), SCHEMAS).collect()
    got = sorted(((r["conv_id"], r["id"], r["status"], r["turn"], r["result_turn"]) for r in found), key=repr)
    assert got == brute_links(rows)
    for conversation in "abc":
        own = sorted((r for r in found if r["conv_id"] == conversation and r["position"] is not None), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        levels = [r["depth"] for r in own]
        assert levels == sorted(levels, key=lambda d: (d is None, d or 0))


def test_repeated_rows_and_long_texts(spark):
    twice = [message("a", 0, call("1", {"q": "abc"})), result("a", 1, "1", "r" * 300_000)] * 2
    got = toolcalls.link_calls(spark.createDataFrame(twice, SCHEMA), SCHEMAS).collect()
    assert sorted(r["status"] for r in got) == ["linked", "repeated", "unanswered"]


def rows_text():
    return json.dumps({"tool_calls": [call("1", {"q": "abc"})]})


def test_long_chains_trees_and_circles(spark):
    ids = [str(k) for k in range(300)]
    rows = [message("chain", 300 - k, call(i, {"q": "abc"}, ids[k - 1] if k else None)) for k, i in enumerate(ids)]
    rows += [message("tree", k, call(str(k), {"q": "abc"}, str((k - 1) // 2) if k else None)) for k in range(63)]
    rows += [message("circle", k, call(str(k), {"q": "abc"}, str((k + 1) % 3))) for k in range(3)]
    rows += [message("circle", 5, call("5", {"q": "abc"}, "0"))]
    got = linked(spark, rows)
    assert all(got["chain", i]["depth"] == k for k, i in enumerate(ids))
    assert all(got["tree", str(k)]["depth"] == (k + 1).bit_length() - 1 for k in range(63))
    assert all(got["circle", k]["depth"] is None and got["circle", k]["problems"] == ["after: a circle"] for k in "0125")


def test_in_order(spark):
    rows = [message("a", 9 - k, call(str(k), {"q": "abc"}, str(k - 1) if k else None)) for k in range(9)]
    out = toolcalls.in_order(toolcalls.link_calls(spark.createDataFrame(rows, SCHEMA), SCHEMAS)).collect()
    assert [r["id"] for r in out] == [str(k) for k in range(9)]


def test_empty_extra_columns_and_no_python(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert toolcalls.link_calls(nothing, SCHEMAS).count() == 0
    rows = spark.createDataFrame([message("a", 0, call("1", {"q": "x" * 100_000}))], SCHEMA)
    clash = rows.withColumns({c: F.lit("x") for c in ("id", "depth", "json", "call", "result", "conversation", "problems", "up")})
    out = toolcalls.link_calls(clash, SCHEMAS)
    assert out.first()["problems"] == ["q: too long"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
