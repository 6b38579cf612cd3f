r"""Chat formatting: tool calls linked to their results, ordered, checked, and written as canonical JSON.

An assistant message holds calls as ``<tool_call>{"id", "name",
"arguments"}</tool_call>``; a message of role ``tool`` holds one result as
JSON with ``tool_call_id``.  Each message gets a row id when it is parsed, and
each call a node id; joins carry these, so that no two messages or calls are
taken for each other.

Calls and results meet by conversation and identifier.  A result belongs to
the latest call of its identifier up to its turn, or to the first later one if
there is none, so an identifier that is used again and again gives one link a
result and never all pairs.  A call depends on another where its arguments
hold ``{"$ref": "<id>"}``; references take the latest earlier call in the same
way.  Messages are range-partitioned by identifier and place, so that a hot
identifier is split over tasks; of each part only its first and last call travel.

Ranks follow the dependencies: 0 without any, else one more than the deepest.
Conversations of at most ``local_edges`` dependencies are ranked whole in a
task; larger ones by pointer doubling along calls with one dependency, and
then by rounds over the calls that branch.

Arguments are checked against a subset of JSON Schema (type, enum,
properties, required, additionalProperties, items).  System messages define
schemas in ``<tools>`` blocks (a JSON list, or one definition a line, plain or
as ``{"function": ...}``), which join calls by conversation and name; a
registry can be given for the rest.  With a registry, a call of a tool that
neither knows is invalid; without one it is not checked and counted apart.

Defined results: a null text is empty; text outside calls stays content; a
block that isn't a JSON object with a name is kept as content and counted as
malformed, as is one with numbers that no JSON can hold or nested too deep; a
call without id gets ``<turn>.<ordinal>``; calls without result are
``unanswered``, results without call ``orphan``; calls in a cycle, or
depending on one, have a null rank and come last; references to unknown ids
are ignored; a message without conversation id is a conversation of its own;
a null turn comes after all others; messages of equal turn are ordered by a
hash of role and text (a result follows all calls of its turn); of several
definitions of a name in a conversation the first holds, unusable schemas
count as none; repeated rows are messages of their own; an empty table gives
an empty table.  JSON has sorted keys, no spaces, non-ASCII as it is, and all
of it comes from ``canonical``.  Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import written

LOCAL_EDGES = 200_000

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
_TOOLS = re.compile(r"<tools>(.*?)</tools>", re.DOTALL)
_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

_CALL_TYPE = pa.struct([
    ("ordinal", pa.int32()), ("call_id", pa.string()), ("id_json", pa.string()), ("name", pa.string()), ("name_json", pa.string()),
    ("arguments", pa.string()), ("refs", pa.list_(pa.string())),
])
_TOOL_TYPE = pa.struct([("name", pa.string()), ("schema", pa.string())])
_PARSED = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.int64()), ("content", pa.string()), ("role_json", pa.string()),
    ("malformed", pa.int64()), ("result_id", pa.string()), ("result_json", pa.string()), ("calls", pa.list_(_CALL_TYPE)), ("tools", pa.list_(_TOOL_TYPE)),
])
PARSED = (
    "conv_id long, turn long, role string, digest long, content string, role_json string, malformed long, result_id string, result_json string, "
    "calls array<struct<ordinal:int,call_id:string,id_json:string,name:string,name_json:string,arguments:string,refs:array<string>>>, "
    "tools array<struct<name:string,schema:string>>"
)


def canonical(value) -> str:
    """Sorted keys, no spaces; surrogates without a partner, which no text can hold, stay escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _name(value: str) -> str:
    """A string as a key of joins."""
    return value.encode("utf-8", "backslashreplace").decode()


def _refuse(what: str):
    raise ValueError(f"{what} is no JSON number")


def _float(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refuse(digits)


def _parsed(text: str):
    return json.loads(text, parse_constant=_refuse, parse_float=_float)


def _object(text: str) -> dict | None:
    try:
        value = _parsed(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return number if kind == "number" else kind in _TYPES and isinstance(value, _TYPES[kind])


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema``, in order of place."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(_is(value, k) for k in kinds):
            return [f"{at}: not {'/'.join(kinds)}"]
    errors = []
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                errors += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                errors.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            errors += schema_errors(x, schema["items"], f"{at}[{i}]")
    return errors


def _refs(value) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            yield value["$ref"]
        else:
            for v in value.values():
                yield from _refs(v)
    elif isinstance(value, list):
        for v in value:
            yield from _refs(v)


def tools_of(role: str | None, text: str) -> list[dict[str, str]]:
    """Names and schemas that a system message defines."""
    if role != "system" or "<tools>" not in text:
        return []
    found = []
    for m in _TOOLS.finditer(text):
        try:
            listed = _parsed(m.group(1))
        except (ValueError, RecursionError):
            listed = [_object(line) for line in m.group(1).splitlines()]
        for tool in listed if isinstance(listed, list) else [listed]:
            if isinstance(tool, dict) and isinstance(tool.get("function"), dict):
                tool = tool["function"]
            if isinstance(tool, dict) and isinstance(tool.get("name"), str) and isinstance(schema := tool.get("parameters", {}), dict):
                found.append({"name": _name(tool["name"]), "schema": canonical(schema)})
    return found


def _call(body: dict | None, turn: int | None, ordinal: int) -> dict | None:
    if not body or not isinstance(body.get("name"), str):
        return None
    own_id, arguments = body.get("id"), body.get("arguments", {})
    own_id = own_id if isinstance(own_id, str) else f"{'none' if turn is None else turn}.{ordinal}"
    if isinstance(arguments, str) and (inner := _object(arguments)) is not None:
        arguments = inner
    try:
        return {
            "ordinal": ordinal, "call_id": _name(own_id), "id_json": canonical(own_id), "name": _name(body["name"]), "name_json": canonical(body["name"]),
            "arguments": canonical(arguments), "refs": sorted({_name(r) for r in _refs(arguments)}),
        }
    except RecursionError:
        return None


def parse_message(turn: int | None, role: str | None, text: str) -> tuple[str, int, str | None, list[dict]]:
    """(content, malformed, result id, calls) of one message."""
    if role == "tool":
        body = _object(text)
        found = body.get("tool_call_id") if body else None
        return text, int(not isinstance(found, str)), found if isinstance(found, str) else None, []
    if role != "assistant" or "<tool_call>" not in text:
        return text, 0, None, []
    calls, malformed, rest, at = [], 0, [], 0
    for m in _CALL.finditer(text):
        call = _call(_object(m.group(1)), turn, len(calls))
        if call is None:
            malformed += 1
            continue
        rest.append(text[at : m.start()])
        at = m.end()
        calls.append(call)
    return "".join([*rest, text[at:]]).strip() if calls else text, malformed, None, calls


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        convs, turns, roles, texts, digests = (batch.column(i).to_pylist() for i in range(5))
        found = []
        for conv, turn, role, text, digest in zip(convs, turns, roles, texts, digests):
            text = text or ""
            content, malformed, result, calls = parse_message(turn, role, text)
            found.append((
                conv, turn, role, digest, canonical(content), canonical(role), malformed, None if result is None else _name(result),
                None if result is None else canonical(result), calls, tools_of(role, text),
            ))
        columns = zip(*found) if found else [()] * len(_PARSED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARSED)], schema=_PARSED)


def parsed(messages: DataFrame) -> DataFrame:
    """The messages with a row id each, written."""
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.xxhash64("role", "text").alias("digest"))
    out = written(rows.mapInArrow(_read, PARSED).withColumn("row", F.monotonically_increasing_id()), "messages")
    return out.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))))


def checked_calls(rows: DataFrame, schemas: dict[str, dict] | None) -> DataFrame:
    """One row per call with node and errors (null: no schema), written."""
    tools = rows.select("conv", "turn", "digest", F.posexplode("tools").alias("place", "t")).groupBy("conv", F.col("t.name").alias("name")).agg(
        F.min(F.struct(F.col("turn").isNull(), "turn", "digest", "place", "t.schema"))["schema"].alias("schema"))
    calls = rows.select("conv", "conv_id", "turn", "row", "digest", F.explode("calls").alias("c")).select("conv", "conv_id", "turn", "row", "digest", "c.*")
    asked = calls.join(tools, ["conv", "name"], "left").select(*calls.columns, "schema")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            errors = []
            for name, arguments, schema in zip(*(batch.column(at(c)).to_pylist() for c in ("name", "arguments", "schema"))):
                try:
                    own = json.loads(schema) if schema is not None else (schemas or {}).get(name)
                    errors.append(schema_errors(json.loads(arguments), own) if own is not None else None if schemas is None else ["unknown tool"])
                except (ValueError, TypeError, AttributeError, RecursionError):
                    errors.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(errors, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "errors"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])
    return written(asked.mapInArrow(check, f"{kinds}, errors array<string>").withColumn("node", F.monotonically_increasing_id()), "calls")


def _place(level: int, ordinal: Column, kind: int) -> Column:
    """Order of calls (kind 1), references (0, just before their call) and results (level 1: after all calls of their turn)."""
    return F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.lit(level).alias("level"), F.col("digest").alias("digest"),
        F.col("row").alias("row"), ordinal.cast("int").alias("ordinal"), F.lit(kind).alias("kind"),
    ).alias("place")


def resolved(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """(conv, of_ref, asker, node): the call that each result (asker: its row) and reference (asker: its call's node) names, or null; written."""
    none = F.lit(None).cast("long")
    offered = calls.select("conv", "call_id", _place(0, F.col("ordinal"), 1), F.col("node"), F.lit(False).alias("of_ref"), none.alias("asker"))
    results = rows.where(F.col("result_id").isNotNull()).select(
        "conv", F.col("result_id").alias("call_id"), _place(1, F.lit(0), 2), none.alias("node"), F.lit(False).alias("of_ref"), F.col("row").alias("asker"))
    refs = calls.select("*", F.explode("refs").alias("ref")).select(
        "conv", F.col("ref").alias("call_id"), _place(0, F.col("ordinal"), 0), none.alias("node"), F.lit(True).alias("of_ref"), F.col("node").alias("asker"))
    events = offered.union(results).union(refs)
    placed = written(events.repartitionByRange("conv", "call_id", "place").withColumn("part", F.spark_partition_id()), "events")
    so_far = Window.partitionBy("part", "conv", "call_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = placed.withColumn("here", F.last("node", ignorenulls=True).over(so_far)).where(F.col("asker").isNotNull())
    # A key has one entry a part at most, however many calls share it.
    own = F.struct("place", "node")
    ends = placed.where(F.col("node").isNotNull()).groupBy("conv", "call_id", "part").agg(F.min(own)["node"].alias("first"), F.max(own)["node"].alias("last"))
    ends = ends.groupBy("conv", "call_id").agg(F.collect_list(F.struct("part", "first", "last")).alias("parts"))
    joined = asked.join(ends, ["conv", "call_id"], "left")
    before = F.array_max(F.filter("parts", lambda p: p["part"] < F.col("part")))["last"]
    return written(joined.select("conv", "of_ref", "asker", F.coalesce("here", before, F.array_min("parts")["first"]).alias("node")), "resolved")


def _rank_whole(key: tuple, edges: pa.Table) -> pa.Table:
    """Ranks of a conversation's calls that have or are dependencies."""
    deps: dict[int, list[int]] = {}
    waiting: dict[int, list[int]] = {}
    for node, ref in zip(edges.column("node").to_pylist(), edges.column("ref").to_pylist()):
        deps.setdefault(node, []).append(ref)
        waiting.setdefault(ref, []).append(node)
    left = {node: len(refs) for node, refs in deps.items()}
    rank = {ref: 0 for ref in waiting if ref not in deps}
    ready = list(rank)
    for ref in ready:  # grows as calls become ready
        for node in waiting.get(ref, ()):
            left[node] -= 1
            if not left[node]:
                rank[node] = 1 + max(rank[r] for r in deps[node])
                ready.append(node)
    nodes = list(left)
    return pa.table({"node": pa.array(nodes, pa.int64()), "rank": pa.array([rank.get(n) for n in nodes], pa.int32())})


def ranks(edges: DataFrame, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, rank) of every node with a dependency (distinct edges conv, node, ref); null in or behind cycles."""
    sizes = written(edges.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > local_edges).select("conv")
    small = edges.join(large, "conv", "left_anti").groupBy("conv").applyInArrow(_rank_whole, "node long, rank int")
    return small if large.isEmpty() else small.union(_rank_rounds(written(edges.join(large, "conv", "left_semi").select("node", "ref"), "edges")))


def _rank_rounds(edges: DataFrame) -> DataFrame:
    """The same for conversations that no task should hold."""
    degrees = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("ref").alias("up"))
    jumps = written(degrees.where("n = 1").select("node", "up", F.lit(1).alias("steps"), F.lit(True).alias("moved")), "jumps")
    doublings = max(1, math.ceil(math.log2(jumps.count() + 1))) + 1
    for _ in range(doublings):
        if jumps.where("moved").isEmpty():
            break
        ahead = jumps.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        jumps = written(jumps.join(ahead, "up", "left").select(
            "node", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")), "jumps")
    # What still moves runs in a cycle: its calls can't be ranked.
    lost, settled = jumps.where("moved").select("node"), jumps.where(~F.col("moved"))
    branching = edges.join(degrees.where("n > 1").select("node"), "node")
    over = settled.select(F.col("node").alias("ref"), F.col("up"), F.col("steps"))
    branching = written(branching.join(over, "ref", "left").select(
        "node", F.coalesce("up", "ref").alias("ref"), (1 + F.coalesce("steps", F.lit(0))).alias("steps")), "branching")
    waiting = branching.select("node").distinct()
    # Edges keep the rank that they have heard; a call is ranked when all of its edges have.
    left = branching.withColumn("heard", F.lit(None).cast("int"))
    new = written(branching.select(F.col("ref").alias("node")).distinct().join(waiting.union(lost), "node", "left_anti").withColumn("rank", F.lit(0)), "ranked")
    done = [new.where("false")]
    while not new.isEmpty():
        told = left.join(new.select(F.col("node").alias("ref"), "rank"), "ref", "left")
        left = written(told.select("node", "ref", "steps", F.greatest(F.col("rank") + F.col("steps"), F.col("heard")).alias("heard")), "waiting")
        new = written(left.groupBy("node").agg(F.count_if(F.col("heard").isNull()).alias("open"), F.max("heard").alias("rank")).where("open = 0").select("node", "rank"), "ranked")
        done.append(new)
        left = left.join(new.select("node"), "node", "left_anti")
    core = done[0]
    for part in done[1:]:
        core = core.union(part)
    core = waiting.join(core, "node", "left")
    # A chain ends at a branching call, whose rank it adds to, or at one without dependencies.
    chains = settled.join(core.select(F.col("node").alias("up"), F.col("rank").alias("base"), F.lit(True).alias("branches")), "up", "left").join(
        lost.select(F.col("node").alias("up"), F.lit(True).alias("lost")), "up", "left")
    base = F.when(F.col("branches"), F.col("base")).when(F.col("lost"), F.lit(None).cast("int")).otherwise(F.lit(0))
    return core.union(chains.select("node", (base + F.col("steps")).alias("rank"))).union(lost.select("node", F.lit(None).cast("int").alias("rank")))


def _ranked(messages: DataFrame, schemas: dict[str, dict] | None, local_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls with rank, and which call each result names."""
    rows = parsed(messages)
    calls = checked_calls(rows, schemas)
    named = resolved(rows, calls)
    edges = named.where(F.col("of_ref") & F.col("node").isNotNull()).select("conv", F.col("asker").alias("node"), F.col("node").alias("ref")).distinct()
    found = written(ranks(written(edges, "edges"), local_edges=local_edges).withColumn("depends", F.lit(True)), "ranks")
    calls = calls.join(found, "node", "left").withColumn("rank", F.when(F.col("depends"), F.col("rank")).otherwise(F.lit(0)))
    return rows, calls.drop("depends"), named.where(~F.col("of_ref")).select(F.col("asker").alias("row"), "node")


def links(messages: DataFrame, schemas: dict[str, dict] | None = None, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """One row per result and per unanswered call: conv_id, call_id, name, turn, ordinal, result_turn, status, valid and errors (null if not checked), arguments, rank."""
    rows, calls, results = _ranked(messages, schemas, local_edges)
    answers = rows.where(F.col("result_id").isNotNull()).select("row", F.col("conv_id").alias("result_conv"), F.col("result_id"), F.col("turn").alias("result_turn")).join(results, "row", "left").drop("row")
    joined = calls.withColumn("called", F.lit(True)).join(answers.withColumn("came", F.lit(True)), "node", "full_outer")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("came").isNull(), "unanswered").otherwise("linked")
    return joined.select(
        F.coalesce("conv_id", "result_conv").alias("conv_id"), F.coalesce("call_id", "result_id").alias("call_id"), "name", "turn", "ordinal", "result_turn", status.alias("status"),
        F.when(F.col("errors").isNotNull(), F.size("errors") == 0).alias("valid"), "errors", "arguments", "rank",
    )


def format_messages(messages: DataFrame, schemas: dict[str, dict] | None = None, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Per message: conv_id, turn, role, n_calls, n_linked, n_invalid, n_unknown (without schema), malformed, answers, ranks (as calls are in the JSON), json."""
    rows, calls, results = _ranked(messages, schemas, local_edges)
    answered = results.where(F.col("node").isNotNull())
    unknown = F.col("errors").isNull() | F.array_contains("errors", "unknown tool")
    per_message = calls.join(answered.select("node").distinct().withColumn("linked", F.lit(True)), "node", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").isNull().alias("late"), "rank", "ordinal", "arguments", "id_json", "name_json", F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce(F.size("errors") > 0, F.lit(False)).alias("invalid"), unknown.alias("unknown"),
    ))).alias("own"))
    joined = rows.join(per_message, "row", "left").join(answered.select("row", F.lit(True).alias("answers")), "row", "left")
    own = F.coalesce("own", F.array().cast(joined.schema["own"].dataType))
    call_json = F.array_join(F.transform(own, lambda c: F.concat(
        F.lit('{"arguments":'), c["arguments"], F.lit(',"id":'), c["id_json"], F.lit(',"name":'), c["name_json"], F.lit("}"))), ",")
    parts = [
        F.concat(F.lit('"content":'), F.col("content")), F.concat(F.lit('"role":'), F.col("role_json")),
        F.when(F.col("result_id").isNotNull(), F.concat(F.lit('"tool_call_id":'), F.col("result_json"))),
        F.when(F.size(own) > 0, F.concat(F.lit('"tool_calls":['), call_json, F.lit("]"))),
    ]

    def count(which: str) -> Column:
        return F.size(F.filter(own, lambda c: c[which])).cast("long")

    return joined.select(
        "conv_id", "turn", "role", F.size(own).cast("long").alias("n_calls"), count("linked").alias("n_linked"), count("invalid").alias("n_invalid"),
        count("unknown").alias("n_unknown"), "malformed", F.coalesce("answers", F.lit(False)).alias("answers"),
        F.transform(own, lambda c: c["rank"]).alias("ranks"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"),
    )
