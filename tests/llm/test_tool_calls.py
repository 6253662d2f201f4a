"""Linking by hand, and canonical JSON against Python's."""
import json

from scanloom.llm import tool_calls as t

SCHEMAS = [("find", "query", "string", True), ("find", "limit", "integer", False), ("find", "where", "object", False),
           ("find", "score", "number", False), ("find", "tags", "array", False), ("find", "exact", "boolean", False)]
GOOD = '{"query": "ä\\n\\"x\\"", "limit": 3}'
CALLS = [("a", "find", GOOD, None), ("b", "find", '{"query":"y","where":{"z":1,"b":[1,{"k":null,"c":2}]},"score":1.5,"tags":[],"exact":true}', "a"),
         ("c", "find", GOOD, "b"), ("d", "find", GOOD, "c"), ("d", "find", GOOD, "c"), ("e", "find", '{"limit": "3", "more": 1}', None),
         ("f", "find", "{bad", None), ("g", "find", None, None), ("h", "find", "[1]", None), ("i", "other", "{}", None),
         ("j", "find", GOOD, "nobody"), ("k", "find", GOOD, "j"), ("l", "find", GOOD, "m"), ("m", "find", GOOD, "l"), ("n", "find", GOOD, "m"),
         ("o", "find", GOOD, None), (None, "find", GOOD, None), ("p", None, GOOD, None), ("q", "find", GOOD, "q")]
RESULTS = [(x, f"result {x}") for x in "abcdefghijklmnpq"] + [("a", "a second"), ("zz", None), (None, "lost")]


def frames(spark, calls, results, schemas=SCHEMAS):
    return (spark.createDataFrame([(*c, "x", 1) for c in calls], "id string, name string, arguments string, need string, level string, status int"),
            spark.createDataFrame([(*r, 2) for r in results], "id string, content string, json int"),
            spark.createDataFrame(schemas, "name string, field string, type string, required boolean"))


def test_link(spark):
    rows = t.link(*frames(spark, CALLS, RESULTS)).collect()
    got = {r.id: r for r in rows if r.id}
    want = {"a": ("ok", 0), "b": ("ok", 1), "c": ("ok", 2), "d": ("ok", 3), "e": ("invalid_arguments", 0), "f": ("invalid_json", 0),
            "g": ("invalid_json", 0), "h": ("invalid_json", 0), "i": ("unknown_tool", 0), "j": ("unknown_need", 0), "k": ("unknown_need", 1),
            "l": ("cyclic", None), "m": ("cyclic", None), "n": ("cyclic", None), "o": ("no_result", 0), "p": ("unknown_tool", 0),
            "q": ("cyclic", None), "zz": ("orphan_result", None)}
    assert {k: (r.status, r.level) for k, r in got.items()} == want
    assert got["e"].errors == ["missing query", "type limit", "unexpected more"]
    assert got["a"].copies == 3 and got["d"].copies == 3 and got["o"].copies == 1
    assert sorted(r.status for r in rows if r.id is None) == ["no_identifier"] * 2
    for key in ("a", "b"):
        arguments = next(json.loads(c[2]) for c in CALLS if c[0] == key)
        content = min(c for i, c in RESULTS if i == key)
        whole = {"arguments": arguments, "id": key, "level": want[key][1], "name": "find", "result": content}
        assert got[key].json == json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_different_calls_and_results_of_one_identifier_all_stay(spark):
    other = '{"query": "other"}'
    calls = [("a", "find", GOOD, None), ("b", "find", GOOD, "a"), ("b", "find", other, "a"), ("b", "find", other, "a"), ("b", "find", other, "none")]
    results = [("a", "x"), ("a", "y"), ("a", "y"), ("a", None), ("b", "z"), ("lost", "1"), ("lost", "2")]
    rows = t.link(*frames(spark, calls, results)).collect()
    got = sorted((r.id, r.status, r.level is None, r.level or 0, r.copies, (json.loads(r.json)["arguments"] or {}).get("query"),
                  str(json.loads(r.json)["result"])) for r in rows)
    good = json.loads(GOOD)["query"]
    assert got == sorted([("a", "ok", False, 0, 5, good, "x"), ("a", "ok", False, 0, 5, good, "y"), ("a", "ok", False, 0, 5, good, "None"),
                          ("b", "ok", False, 1, 5, good, "z"), ("b", "ok", False, 1, 5, "other", "z"), ("b", "unknown_need", False, 0, 5, "other", "z"),
                          ("lost", "orphan_result", True, 0, 2, None, "1"), ("lost", "orphan_result", True, 0, 2, None, "2")])


def test_turns_without_identifier_stay_apart(spark, tmp_path):
    from scanloom.llm.queries import op5_tool_calls

    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (None, 0, "user", "s"), (None, 0, "user", "t"), (None, 1, "assistant", "u"), (2, None, "user", "v")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.id or "", r.status) for r in op5_tool_calls(spark, str(tmp_path)).collect())
    assert got == [("", "no_identifier")] * 4 + [("1:0", "ok")]


def test_levels_of_a_long_chain(spark):
    calls = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(130)]
    got = t.levels(spark.createDataFrame(calls[::-1], "id string, need string")).collect()
    assert {r.id: r.level for r in got} == {f"c{i}": i for i in range(130)}


def test_empty(spark):
    calls, results, schemas = frames(spark, CALLS, RESULTS)
    assert t.link(calls.limit(0), results.limit(0), schemas).count() == 0
    assert {r.status for r in t.link(calls.limit(0), results, schemas).collect()} == {"orphan_result", "no_identifier"}
    assert "ok" not in {r.status for r in t.link(calls, results, schemas.limit(0)).collect()}
