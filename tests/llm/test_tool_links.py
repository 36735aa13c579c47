import json
import random

from inboxlake.llm.tool_links import canonical, linked, problems

SCHEMAS = {"find": {"q": ("string", True), "n": ("integer", False), "x": ("number", False), "b": ("boolean", False), "a": ("array", False), "o": ("object", False)}}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status string, line string"
RESULTS = "conv_id long, call_id string, turn long, content string, valid int"


def test_canonical_json():
    assert canonical({"b": [1, {"z": None, "a": "é\n"}], "a": 1.5}) == '{"a":1.5,"b":[1,{"a":"é\\n","z":null}]}'
    assert json.loads(canonical({"k": "\u2028\x01"})) == {"k": "\u2028\x01"}


def test_problems():
    check = lambda x: problems("find", x, SCHEMAS)[0]
    assert check('{"q": "x", "n": 3, "x": 1.5, "b": true, "a": [], "o": {}}') == []
    assert check('{"n": true, "b": 1, "z": 0}') == ["b is not boolean", "n is not integer", "q is missing", "z is unknown"]
    assert check("[1]") == ["arguments are not an object"] and check(None) == ["arguments are not an object"]
    assert check("{") == ["arguments are not JSON"] and problems("other", "{}", SCHEMAS)[0] == ["unknown tool"]
    assert problems(None, "{}", SCHEMAS)[0] == ["unknown tool"]


def rows_of(spark, folder, calls, results):
    calls = spark.createDataFrame([(*c, "s", "l") for c in calls], CALLS)
    results = spark.createDataFrame([(*r, 1) for r in results], RESULTS)
    return linked(calls, results, SCHEMAS, folder).collect()


def test_links_order_and_states(spark, folder):
    good = '{"q":"x"}'
    calls = [
        (1, "a", 5, "find", good, ["b", "c"]), (1, "b", 1, "find", good, []), (1, "c", 9, "find", good, ["b", "nowhere"]), (1, "d", 2, "find", good, None),
        (1, "e", 3, "find", good, ["f"]), (1, "f", 4, "find", good, ["e"]), (1, "g", 6, "find", good, ["e"]), (2, "a", 1, "find", good, ["b"]),
        (1, "b", 0, None, None, ["a"]), (None, "n", 1, "find", good, []), (1, None, 1, "find", good, []),
    ]
    calls[8] = (1, "b", 7, None, None, ["a"])  # a second call of one id, later
    results = [(1, "a", 6, "late"), (1, "a", 5, "second"), (1, "a", 5, "first"), (2, "b", 2, "lost"), (None, "n", 2, "none"), (1, "e", 4, None)]
    got = {(r.conv_id, r.call_id, r.status): r for r in rows_of(spark, folder, calls, results)}
    state = {k[:2] + (k[2],): r.level for k, r in got.items()}
    assert state == {
        (1, "a", "answered"): 2, (1, "b", "pending"): 0, (1, "c", "pending"): 1, (1, "d", "pending"): 0, (1, "e", "cycle"): None, (1, "f", "cycle"): None,
        (1, "g", "cycle"): None, (2, "a", "pending"): 0, (2, "b", "orphan"): None, (None, "n", "pending"): None, (None, "n", "orphan"): None, (1, None, "pending"): None,
    }
    assert got[1, "a", "answered"].line == '{"arguments":{"q":"x"},"call_id":"a","name":"find","result":"first"}'
    assert got[2, "b", "orphan"].valid and got[2, "b", "orphan"].line == '{"arguments":null,"call_id":"b","name":null,"result":"lost"}'


def test_empty(spark, folder):
    assert rows_of(spark, folder, [], []) == []


def test_odd_arguments(spark, folder):
    odd = ['{"q":"\\ud800"}', "[" * 100_000, "NaN", '{"q":"x","x":1e999}', '{"q":"x","x":-Infinity}', '{"\\udfff":1,"q":"x"}', "", '{"q":"' + "long " * 20_000 + '"}', "9" * 5000]
    calls = [(1, f"c{i:02}", i, "find", x, []) for i, x in enumerate(odd)]
    got = {r.call_id: r for r in rows_of(spark, folder, calls, [(1, "c00", 1, "")])}
    assert got["c00"].valid and got["c00"].line.endswith('"result":""}') and "\\ud800" in got["c00"].line
    assert [got[f"c{i:02}"].problems for i in (1, 2, 3, 4, 6, 8)] == ["arguments are not JSON"] * 6
    assert got["c05"].problems == "\\udfff is unknown" and got["c07"].valid
    for r in got.values():
        json.loads(r.line, parse_constant=lambda x: 1 / 0)


def test_tied_calls_have_one_answer(spark, folder):
    calls = [(1, "a", 1, name, '{"q":"x"}', needs) for name in ("find", "seek", None) for needs in (["b"], [], None)] + [(1, "b", 0, "find", "{}", [])]
    once = rows_of(spark, folder, calls, [])
    again = rows_of(spark, folder, calls[::-1], [])
    assert sorted(once, key=str) == sorted(again, key=str) and len(once) == 2


def test_long_chains_and_random_graphs(spark, folder):
    draw = random.Random(6)
    chain = [(1, f"{i}", i, "find", "{}", [f"{i - 1}"]) for i in range(200)]
    mixed = [(2, f"{i}", i, "find", "{}", [f"{draw.randrange(60)}" for _ in range(draw.choice([0, 1, 1, 1, 2, 3]))]) for i in range(60)]
    acyclic = [(3, f"{i}", i, "find", "{}", [f"{draw.randrange(i)}" for _ in range(draw.choice([0, 1, 1, 2, 3]))] if i else []) for i in range(80)]
    calls = chain + mixed + acyclic
    want = {}
    for _ in range(len(calls)):
        for c, i, *_, needs in calls:
            real = [(c, x) for x in set(needs) if any(k[:2] == (c, x) for k in calls)]
            if all(x in want for x in real):
                want[c, i] = max((want[x] + 1 for x in real), default=0)
        if len(want) == len(calls):
            break
    got = {(r.conv_id, r.call_id): r.level for r in rows_of(spark, folder, calls, []) if r.level is not None}
    assert got == want and max(v for (c, _), v in got.items() if c == 1) == 199
