import hashlib
import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factweave.operators import audit, binding, narrate
from factweave.plans.calendar import build_plan
from factweave.plans.run import INCOMPLETE, OK, REFUSED, RunConfig, build_factbook, run
from factweave.plans.spec import shop_registry
from factweave.sources.cells import cells_from_events
from factweave.sources.digest import source_digest
from factweave.sources.synthetic import SHOP, generate_cells
from factweave.streaming.cells import daily_cells, read_events, write_cells

AS_OF = date(2024, 8, 15)
REGISTRY = shop_registry(*SHOP.dims)


@pytest.fixture(scope="session")
def cells(spark):
    return generate_cells(spark, AS_OF - timedelta(days=90), AS_OF - timedelta(days=1)).persist()


@pytest.fixture(scope="session")
def book(spark, cells, tmp_path_factory):
    return build_factbook(cells, REGISTRY, SHOP, build_plan(AS_OF), str(tmp_path_factory.mktemp("book")))


def test_number_of_facts(book):
    segments = 5 + 7
    series = 5 * (1 + segments)
    want = series * 102 + 3 * segments + 2 * 2 * (1 + segments) + (1 + segments)
    assert book.facts.count() == want == book.facts.select("id").distinct().count()
    assert audit.unresolved_inputs(book.facts).count() == 0


def test_deltas_of_segments_add_up(book):
    rows = book.facts.where("metric_id = 'gmv' AND statistic_key = 'wow_delta'").groupBy(F.coalesce("cut_dim", F.lit("all")).alias("d")).agg(F.sum("value").alias("v")).collect()
    assert len({round(r.v, 4) for r in rows}) == 1


def test_planted_events_are_listed(book):
    found = {(r.cut, c) for r in book.shortlist.collect() for c in r.channels}
    assert any(cut != "overall" for cut, _ in found)
    assert {c for _, c in found} >= {"overall", "screening_z"}
    assert book.pack.count() < book.facts.count()


def check(spark, book, *highlights, dismissals=()):
    text = json.dumps({"highlights": list(highlights), "dismissals": list(dismissals)})
    drafts = spark.createDataFrame([("d", text)], "draft_id string, text string")
    violations, bindings = binding.validate(drafts, book.facts, book.pack, book.shortlist, REGISTRY, book.plan)
    return sorted(r.code for r in violations.collect()), [r.status for r in bindings.orderBy("claim").collect()]


@pytest.fixture(scope="session")
def fact(book):
    return book.pack.where(f"id = 'gmv/overall/{book.plan.week.label}/value'").first()


def story(fact, **change):
    return {"title": "GMV moved", "metric_id": "gmv", "cut": "overall", "severity": "low", "narrative": f"GMV stands at {fact.display}.",
            "claims": [{"fact_id": fact.id, "value": fact.value}], **change}


def test_true_story_passes(spark, book, fact):
    assert check(spark, book, story(fact)) == ([], ["bound"])


@pytest.mark.parametrize("change,codes", [
    ({"narrative": "GMV stands at $1."}, ["E020"]), ({"narrative": "It moved on 2020-01-01."}, ["E021"]), ({"narrative": "In week32 it moved."}, ["E022"]),
    ({"narrative": "It roughly moved."}, ["E024"]), ({"narrative": "It moved because of rain."}, ["E030"]), ({"hypothesis": "Because of rain."}, []),
    ({"narrative": "See <b>this</b>"}, ["E040"]), ({"narrative": "see evil.com"}, ["E040"]), ({"title": "# Head"}, ["E040"]), ({"severity": "huge"}, ["E003"]),
    ({"cut": "country=XX"}, ["E004", "E014", "E020"]), ({"metric_id": "nope"}, ["E002", "E014", "E020"]), ({"narrative": 5}, ["E001"]), ({"claims": "x"}, ["E001", "E020"]),
])
def test_bad_stories(spark, book, fact, change, codes):
    assert check(spark, book, story(fact, **change))[0] == codes


def test_bad_claims(spark, book, fact):
    old = f"gmv/overall/{book.plan.earlier_weeks[2].label}/value"
    claims = [{"fact_id": "x/y/z/w", "value": 1}, {"fact_id": old, "value": 1}, {"fact_id": fact.id, "value": -fact.value}, {"fact_id": fact.id, "value": "n"}, {"value": 1}]
    assert check(spark, book, story(fact, narrative="-", claims=claims)) == (["E001", "E010", "E011", "E012", "E012"], ["dangling", "not_in_pack", "mismatch", "mismatch"])


def test_wrong_unit_and_dismissals(spark, book, fact):
    bare = story(fact, narrative=f"GMV stands at {fact.display.replace('$', '')}.")
    assert check(spark, book, bare)[0] == ["E023"]
    assert check(spark, book, dismissals=[{"shortlist_rank": 999, "reason_code": "x"}, {"shortlist_rank": [1], "reason_code": "data-quality"}, {}])[0] == ["E001", "E050", "E051", "E051"]


def test_prior_week_alone_is_no_anchor(spark, book):
    prior = book.pack.where(f"id = 'gmv/overall/{book.plan.earlier_weeks[0].label}/value'").first()
    assert check(spark, book, story(prior))[0] == ["E015"]


@pytest.mark.parametrize("text", ["", "[]", "{", '{"highlights": 3}', "no json"])
def test_unreadable_drafts(spark, book, text):
    drafts = spark.createDataFrame([("d", text)], "draft_id string, text string")
    violations, _ = binding.validate(drafts, book.facts, book.pack, book.shortlist, REGISTRY, book.plan)
    assert [r.code for r in violations.collect()] == ["E001"]


def test_run_writes_a_checked_report(cells, tmp_path):
    assert run(cells, REGISTRY, SHOP, RunConfig(AS_OF, str(tmp_path))) == OK
    audit_file = json.loads((tmp_path / "audit.json").read_text())
    claims = audit_file["attempts"][-1]["claims"]
    assert not audit_file["attempts"][-1]["violations"] and claims and all(c["derivation"][0]["fact_id"] == c["fact_id"] for c in claims)
    facts = json.loads((tmp_path / "facts.json").read_text(encoding="utf-8"))
    assert facts["run_id"] == audit_file["run_id"] and list(facts["facts"]) == sorted(facts["facts"]) and list(facts) == sorted(facts)
    inputs = {i for c in claims for d in c["derivation"] for i in d["inputs"] if not i.startswith("source_rows:")}
    assert inputs <= set(facts["facts"]) and all(facts["facts"][c["fact_id"]]["display"] == c["display"] for c in claims)
    assert len(facts["shortlist"]) == len(json.loads((tmp_path / "pack.json").read_text())["shortlist"])
    assert "# Weekly highlights" in (tmp_path / "report.md").read_text()


def test_run_gives_up_on_a_stubborn_writer(cells, tmp_path):
    bad = narrate.ScriptedProvider("nonsense", "still nonsense")
    assert run(cells, REGISTRY, SHOP, RunConfig(AS_OF, str(tmp_path), max_retries=1), bad) == REFUSED
    assert len(bad.prompts) == 2 and narrate.REPORT[0] in bad.prompts[1] and not (tmp_path / "report.md").exists()


def test_incomplete_run(spark, cells, tmp_path):
    short = cells.where(F.col("day") < F.lit(AS_OF - timedelta(days=2)))
    assert run(short, REGISTRY, SHOP, RunConfig(AS_OF, str(tmp_path)), narrate.ScriptedProvider("{}")) == INCOMPLETE


def test_stream_gives_the_batch_cells(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    write_cells(daily_cells(read_events(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.day, r.bucket, r.part): (r.sessions, r.orders, r.gmv) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.day, r.bucket, r.part): (r.sessions, r.orders, r.gmv) for r in cells_from_events(events).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 48


def test_command_line(spark, tmp_path):
    from factweave.cli import main

    cells = str(tmp_path / "cells")
    assert main(["generate", "--out", cells, "--days", "80", "--as-of", "2024-08-15"]) == 0
    registry = str(__import__("pathlib").Path(__file__).parent.parent / "examples" / "shop.toml")
    assert main(["run", "--source", cells, "--out", str(tmp_path / "o"), "--as-of", "2024-08-15", "--registry", registry]) == OK
    assert main(["run", "--source", str(tmp_path / "none"), "--out", str(tmp_path / "p")]) == 1
    audit_file = json.loads((tmp_path / "o" / "audit.json").read_text())
    assert audit_file["source_sha256"] == source_digest(spark, cells)
    key = f"{audit_file['source_sha256']}:{audit_file['registry_sha256']}:2024-08-15"
    assert audit_file["run_id"] == f"2024-08-15-{hashlib.sha256(key.encode()).hexdigest()[:10]}"
