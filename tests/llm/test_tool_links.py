"""Tool calls against a brute-force reading: repeated turns and identifiers, null keys, control characters, chains and cycles."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F
from test_operators import call

import __spark_entry__ as entry
from factweave.llm import queries, tool_calls

SCHEMA = "conv_id long, turn long, role string, text string, row string, node int, rank double, json array<int>"
TOOLS = {"add": {"type": "object", "properties": {"a": {"type": ["integer", "object", "array"]}}, "required": ["a"]}, "say": {}}


def talk(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv, turn = rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(12), None])
        key = lambda: rng.choice(["a", "b", "c", "d", "é\u001f", f"k{rng.randrange(30)}"])
        if rng.random() < 0.5:
            parts = []
            for _ in range(rng.randint(0, 4)):
                value = rng.choice([1, 2.5, "x\u0001\u001f\"/", {"$ref": key()}, [{"$ref": key()}, {"$ref": key()}], None])
                body = {"id": key(), "name": rng.choice(["add", "say", "nobody"]), "arguments": {"a": value, "b": " "}}
                if rng.random() < 0.2:
                    del body["id"]
                parts.append(rng.choice(["", " said\t"]) + f"<tool_call>{json.dumps(body)}</tool_call>")
            rows.append((conv, turn, "assistant", "".join(parts) + rng.choice(["", "<tool_call>[</tool_call>", "\u0007 end"])))
        else:
            rows.append((conv, turn, rng.choice(["tool", "tool", "user"]), json.dumps({"tool_call_id": key(), "content": "é\n"}) if rng.random() < 0.9 else "plain"))
    return rows + rows[:10] + [(None, None, None, None), (4, 0, "assistant", None)]


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def brute(rows):
    """{message: (n_calls, n_linked, n_invalid, n_unknown, answers, ranks, json)} in any order, from every message's calls and the events before it."""
    calls, asks, own = [], [], collections.defaultdict(list)
    for i, (conv, turn, role, text, digest) in enumerate(rows):
        place, key = (turn is None, turn or 0), f"row {i}" if conv is None else conv
        if role == "assistant":
            k = 0
            for m in tool_calls._CALL.finditer(text or ""):
                try:
                    body = json.loads(m.group(1))
                    name = body["name"]
                except (ValueError, TypeError, KeyError):
                    continue
                found = {"id": body.get("id", f"{'none' if turn is None else turn}.{k}"), "name": name, "arguments": body["arguments"], "at": (*place, 0, digest, i, k), "conv": key, "k": k}
                calls.append(found)
                own[i].append(found)
                k += 1
        elif role == "tool" and (text or "").startswith("{"):
            asks.append((key, json.loads(text)["tool_call_id"], (*place, 1, digest, i, 0), i))

    def named(conv, wanted, at):
        among = [c for c in calls if c["conv"] == conv and c["id"] == wanted]
        before = [c for c in among if c["at"] < at]
        return max(before, key=lambda c: c["at"]) if before else min(among, key=lambda c: c["at"], default=None)

    answered, linked = set(), set()
    for conv, wanted, at, i in asks:
        if (c := named(conv, wanted, at)) is not None:
            answered.add(i)
            linked.add(id(c))
    deps = {id(c): {id(d) for r in set(tool_calls._refs(c["arguments"])) if (d := named(c["conv"], r, c["at"])) is not None} for c in calls}
    rank = {}
    for level in range(len(calls) + 1):
        new = {c: level for c, refs in deps.items() if c not in rank and refs <= set(rank)}
        if not new:
            break
        rank |= new
    out = []
    for i, (conv, turn, role, text, _) in enumerate(rows):
        found = sorted(own[i], key=lambda c: (id(c) not in rank, rank.get(id(c), 0), c["k"]))
        bad = lambda c: c["name"] == "nobody" or (c["name"] == "add" and not isinstance(c["arguments"]["a"], (int, dict, list)))
        content, message = text or "", {"role": role}
        if found:
            for m in list(tool_calls._CALL.finditer(content)):
                if m.group(1) != "[":
                    content = content.replace(m.group(), "", 1)
            content = content.strip()
            message["tool_calls"] = [{k: c[k] for k in ("arguments", "id", "name")} for c in found]
        message["content"] = content
        if role == "tool" and content.startswith("{"):
            message["tool_call_id"] = json.loads(content)["tool_call_id"]
        out.append((conv, turn, role, len(found), sum(id(c) in linked for c in found), sum(map(bad, found)), sum(c["name"] == "nobody" for c in found), i in answered,
                    tuple(rank.get(id(c)) for c in found), canonical(message)))
    return collections.Counter(out)


@pytest.mark.parametrize("seed,local_edges", [(1, 10**6), (2, 0), (3, 12)])
def test_against_brute_force(spark, seed, local_edges):
    rows = talk(seed)
    df = spark.createDataFrame([(*r, "own", 1, 0.5, [1]) for r in rows], SCHEMA).repartition(3)
    digests = [tuple(r) for r in df.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text")).collect()]
    got = tool_calls.format_messages(df, TOOLS, local_edges=local_edges).collect()
    assert collections.Counter(
        (r.conv_id, r.turn, r.role, r.n_calls, r.n_linked, r.n_invalid, r.n_unknown, r.answers, tuple(r.ranks), r.json) for r in got) == brute(digests)
    found = tool_calls.links(df, TOOLS, local_edges=local_edges)
    assert found.where("status <> 'unanswered'").count() == sum(1 for r in got if r.role == "tool" and "tool_call_id" in json.loads(r.json))
    assert found.where("status <> 'orphan'").select("conv_id", "turn", "call_id", "ordinal").distinct().count() <= sum(r.n_calls for r in got)


def test_equal_turns_lose_no_call(spark):
    rows = [(1, 1, "assistant", call("x", "add", a=1)), (1, 1, "assistant", call("y", "add", a=2)), (None, 0, "assistant", call("p", "add", a=1)),
            (None, 0, "assistant", call("q", "add", a=1)), (5, None, "assistant", "text" + call("z", "add", a=1)), (5, None, "tool", '{"tool_call_id":"z"}')]
    out = tool_calls.format_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(c["id"] for r in out for c in json.loads(r.json).get("tool_calls", [])) == ["p", "q", "x", "y", "z"]
    assert sum(r.n_linked for r in out) == 1 and all(tool_calls.canonical(json.loads(r.json)) == r.json for r in out)


@pytest.mark.parametrize("local_edges", [10**6, 0])
def test_deep_chains(spark, local_edges):
    rows = [(1, i, "assistant", call(f"c{i}", "add", a={"$ref": f"c{i - 1}"})) for i in range(501)]
    rows += [(2, i, "assistant", call(f"c{i}", "add", a={"$ref": f"c{(i + 1) % 40}"}) + call(f"d{i}", "add", a=[{"$ref": f"c{i}"}, {"$ref": "e0"}]) + call(f"e{i}", "add", a=1)) for i in range(40)]
    rows += [(3, i, "assistant", call(f"c{i}", "add", a=[{"$ref": f"c{i - 1}"}, {"$ref": f"c{i - 2}"}])) for i in range(6)]
    found = tool_calls.links(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), local_edges=local_edges).collect()
    rank = {(r.conv_id, r.call_id): r["rank"] for r in found}
    assert all(rank[1, f"c{i}"] == i for i in range(501))
    assert all(rank[2, f"c{i}"] is None and rank[2, f"d{i}"] is None and rank[2, f"e{i}"] == 0 for i in range(40))
    assert [rank[3, f"c{i}"] for i in range(6)] == [0, 1, 2, 3, 4, 5]


def test_a_hot_identifier_gives_one_link_a_result(spark):
    rows = [(1, t, role, text) for t in range(0, 600, 2) for role, text in (("assistant", call("same", "add", a=t)), ("tool", '{"tool_call_id":"same"}'))]
    found = tool_calls.links(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert len(found) == 300 and all(r.status == "linked" and r.turn == r.result_turn for r in found)


@pytest.mark.parametrize("body,content", [
    ('{"name":"f","arguments":{"x":NaN}}', None), ('{"name":"f","arguments":{"x":1e999}}', None), ('{"name":"f","arguments":{"x":' + "[" * 50_000 + "]" * 50_000 + "}}", None),
    ('{"name":"f","arguments":{"x":' + "9" * 5000 + "}}", None), ('{"name":"\\ud800","arguments":"{\\"b\\":1,\\"a\\":2}","id":7}', '{"arguments":{"a":2,"b":1},"id":"0.0","name":"\\ud800"}'),
])
def test_odd_json(spark, body, content):
    df = spark.createDataFrame([(1, 0, "assistant", f"<tool_call>{body}</tool_call>")], "conv_id long, turn long, role string, text string")
    r = tool_calls.format_messages(df, {}).first()
    assert (r.malformed, r.n_calls) == ((1, 0) if content is None else (0, 1)) and (content is None or content in r.json)


def test_empty_and_derived(spark):
    assert tool_calls.format_messages(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0 and tool_calls.links(spark.createDataFrame([], SCHEMA)).count() == 0
    sf = "/root/testdata/sf0.001"
    out = entry.queries()["op1_tool_calls"](spark, sf).collect()
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    asks = given.where("role = 'assistant'").count()
    assert sum(r.n_calls for r in out) == asks and len(out) == queries.as_tool_talk(given).count() > given.count() and not sum(r.malformed for r in out)
    assert 0 < sum(r.n_invalid for r in out) < asks and 0 < sum(r.n_linked for r in out) < asks and max(k for r in out for k in r.ranks) >= 2
