import json
import random

from pyspark.sql import functions as F

from factweave.operators import audit, render

PARTS = ["#", "##", "#######", "-", "*", "+", ">", "|", "<", " ", "  ", "\n", "\t", "\r", "\x00", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "1.", "12.", "٣.", "½.", "é", "三", "a", "b c", "\\", "$"]


def test_expressions_are_plain(spark):
    r = random.Random(7)
    texts = sorted({"".join(r.choice(PARTS) for _ in range(r.randint(0, 7))) for _ in range(6000)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", render.plain_text(F.col("t")).alias("p"), render.plain_cell(F.col("t")).alias("c"), render.redactions(F.col("t")).alias("n")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        plain = render.Plain()
        assert (row.p, row.n) == (plain.text(row.t), plain.redactions), row.t
        assert row.c == render.Plain().cell(row.t)


def test_null_is_shown_as_nothing(spark):
    text = json.dumps({"highlights": [{"title": None, "severity": 3, "narrative": ["a", {"b": 1}]}, "word", None, {}]})
    drafts = spark.createDataFrame([("d", text), ("none", None), ("bad", "{"), ("empty", '{"highlights": []}')], "draft_id string, text string")
    rows = render.rendered(drafts).orderBy("place").collect()
    assert [(r.draft_id, r.highlight, r.place, r.redactions) for r in rows] == [("d", i, i + 1, 0) for i in range(4)]
    assert (rows[0].title, rows[0].severity, rows[0].narrative) == ("", "3", '["a",{"b":1}]')
    assert all(r.title == r.narrative == r.hypothesis == "" for r in rows[1:])


FACT = "id string, label string, display string, unit string, period_type string, period_start date, period_end date, flags array<string>, provenance struct<computation:string,formula:string,inputs:array<string>,note:string>"
BINDING = "draft_id string, highlight int, claim int, fact_id string, claimed double, computed double, tolerance double, status string"


def some_facts(spark):
    fact = lambda i, inputs: (i, f"label {i}", f"|{i}", "usd", "week", None, None, ["z", "a"], ("c", "f < 1", inputs, None))
    # a reaches d by two ways, and round to itself
    return spark.createDataFrame([fact("a", ["b", "c", "d"]), fact("b", ["d", "source_rows:x"]), fact("c", ["a", "gone"]), fact("d", ["e"]), fact("e", ["f"]), fact("f", [])], FACT)


def test_trails(spark):
    drafts = spark.createDataFrame([("d", json.dumps({"highlights": [{"title": "<b>", "metric_id": "gmv"}]}))], "draft_id string, text string")
    bindings = spark.createDataFrame([("d", 0, 0, "a", 1.5, None, 0.5, "bound"), ("d", 0, 1, "nope", 2.0, None, None, "dangling"), ("d", 0, 2, "a", float("nan"), 1.0, 0.5, "mismatch"), ("other", 5, 0, "f", 1.0, 1.0, 0.5, "bound")], BINDING)
    found = {(r.draft_id, r.claim): json.loads(r.audit) for r in audit.claim_trail(drafts, bindings, some_facts(spark)).collect()}
    assert len(found) == 4
    first = found["d", 0]
    assert list(first) == sorted(first) and list(first["period"]) == ["end", "start", "type"] and first["highlight_title"] == "<b>"
    assert [s["fact_id"] for s in first["derivation"]] == ["a", "b", "c", "d", "e"] and first["derivation"][1]["inputs"] == ["d", "source_rows:x"]
    assert list(first["derivation"][0]) == ["computation", "fact_id", "flags", "formula", "inputs", "note"] and first["derivation"][0]["note"] is None
    assert found["d", 1]["derivation"] == [] and found["d", 1]["display"] is None and found["d", 1]["claimed_value"] == 2.0
    assert found["d", 2]["claimed_value"] is None and found["d", 2]["derivation"] == first["derivation"]
    assert [s["fact_id"] for s in found["other", 0]["derivation"]] == ["f"] and found["other", 0]["highlight_title"] is None


def test_evidence_of_highlights(spark):
    drafts = spark.createDataFrame([("d", json.dumps({"highlights": [{"title": "x", "severity": "low"}, {"title": "# y", "severity": "high"}]}))], "draft_id string, text string")
    bindings = spark.createDataFrame([("d", 1, 1, "b", 1.0, 1.0, 0.5, "bound"), ("d", 1, 0, "a", 1.0, 1.0, 0.5, "bound"), ("d", 1, 2, "nope", 1.0, 1.0, 0.5, "dangling")], BINDING)
    rows = {r.place: r for r in render.rendered(drafts, bindings, some_facts(spark)).collect()}
    assert rows[1].highlight == 1 and rows[1].title == "\\# y" and rows[1].redactions == 1
    assert [tuple(e) for e in rows[1].evidence] == [("a", "\\|a", "f  1"), ("b", "\\|b", "f  1")] and rows[2].evidence is None
