"""Schemas that system messages define: joined by conversation and name; calls without one are counted apart."""

import json

from test_operators import call

from factweave.llm import tool_calls

ADD = {"name": "add", "parameters": {"type": "object", "properties": {"a": {"type": ["number", "object"]}}, "required": ["a"], "additionalProperties": False}}
BAD = {"name": "bad", "parameters": {"properties": {"a": 1}}}


def test_schemas_from_the_data(spark, tmp_path):
    talk = [
        (1, 0, "system", f"You may call <tools>{json.dumps([ADD, {'type': 'function', 'function': {'name': 'mul'}}, BAD])}</tools>"),
        (1, 1, "assistant", call("c2", "add", a={"$ref": "c1"}) + call("c1", "add", a=1) + call("c3", "add", b=1) + call("c4", "mul", x=1) + call("c5", "none") + call("c6", "bad", a=1)),
        (1, 2, "tool", '{"tool_call_id":"c1","content":3}'),
        (2, 0, "system", "<tools>\n" + json.dumps({"name": "add", "parameters": {"required": ["b"]}}) + "\nnot json\n</tools>"),
        (2, 1, "system", f"<tools>{json.dumps(ADD)}</tools>"),
        (2, 2, "assistant", call("d1", "add", a=1)), (3, 0, "user", f"<tools>{json.dumps([ADD])}</tools>"), (3, 1, "assistant", call("e1", "add", a="x")),
    ]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {(r.conv_id, r.turn): r for r in tool_calls.format_messages(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()}
    assert len(out) == len(talk)
    r = out[1, 1]
    assert (r.n_calls, r.n_linked, r.n_invalid, r.n_unknown) == (6, 1, 1, 2)
    assert [c["id"] for c in json.loads(r.json)["tool_calls"]] == ["c1", "c3", "c4", "c5", "c6", "c2"] and r.ranks == [0, 0, 0, 0, 0, 1]
    assert (out[2, 2].n_invalid, out[2, 2].n_unknown) == (1, 0) and (out[3, 1].n_invalid, out[3, 1].n_unknown) == (0, 1)
    assert out[1, 0].n_calls == 0 and out[1, 0].ranks == []
    errors = {r.call_id: r.errors for r in tool_calls.links(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()}
    assert errors == {"c1": [], "c2": [], "c3": ["$.a: missing", "$.b: not allowed"], "c4": [], "c5": None, "c6": None, "d1": ["$.b: missing"], "e1": None}
