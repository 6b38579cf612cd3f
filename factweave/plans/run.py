"""A whole run: cells to facts to a checked report.  Facts are written before any writer sees them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import audit, binding, facts as facts_op, narrate, records as records_op, render, shortlist as shortlist_op, stories
from factweave.plans.calendar import ReportPlan, build_plan
from factweave.plans.spec import Registry, SourceSpec
from factweave.sources.json_file import write_json

OK, BAD_INPUT, REFUSED, INCOMPLETE = 0, 1, 2, 3


@dataclass
class RunConfig:
    as_of: date
    out: str
    brief: str = ""
    max_retries: int = 2
    weeks_back: int = 4
    days_back: int = 8


@dataclass
class FactBook:
    """Facts, shortlist and pack of one run, as tables."""

    plan: ReportPlan
    coverage: list[dict]
    facts: DataFrame
    shortlist: DataFrame
    pack: DataFrame
    stories: DataFrame

    @property
    def incomplete(self) -> bool:
        return any(c["required"] and c["status"] != "ok" for c in self.coverage)

    def pack_document(self) -> dict:
        """What a writer gets: bounded by the shortlist."""
        rows = self.pack.orderBy("rank", "pos").select("id", "label", "value", "display", "unit", "flags").collect()
        told = self.stories.select("rank", "kind", "severity", F.col("day").cast("string").alias("day"), "outcome", "place")
        items = self.shortlist.select("rank", "metric_id", "cut", "channels", "fact_ids").join(told, "rank").orderBy("rank").collect()
        return {
            "week_start": self.plan.week.start.isoformat(), "week_end": self.plan.week.end.isoformat(),
            "shortlist": [r.asDict() for r in items], "facts": [r.asDict() for r in rows],
        }


def build_factbook(cells: DataFrame, registry: Registry, spec: SourceSpec, plan: ReportPlan, folder: str | None = None) -> FactBook:
    """Facts of all metrics whose coverage is ok; with ``folder``, written there as Parquet first."""
    spark = cells.sparkSession
    status = [r.asDict() for r in records_op.coverage(cells, registry, plan).orderBy("metric_id").collect()]
    fine = {s["metric_id"] for s in status if s["status"] == "ok"}
    usable = Registry(tuple(m for m in registry.metrics if m.id in fine), registry.sha256)

    def kept(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return df
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = kept(records_op.records(cells, usable if usable.metrics else registry, spec, plan).where(F.lit(bool(fine))), "records")
    wide = facts_op.compared(rows, registry, plan)
    found = kept(facts_op.facts(wide, plan), "facts")
    chosen = kept(shortlist_op.shortlist(wide, registry, plan), "shortlist")
    told = kept(stories.select_stories(stories.of_report(wide, chosen, plan)), "stories")
    return FactBook(plan, status, found, chosen, kept(shortlist_op.pack(found, chosen), "pack"), told)


def run_id(as_of: date, source_sha256: str, registry_sha256: str) -> str:
    key = f"{source_sha256}:{registry_sha256}:{as_of.isoformat()}"
    return f"{as_of.isoformat()}-{hashlib.sha256(key.encode()).hexdigest()[:10]}"


def fingerprint(cells: DataFrame) -> str:
    """A digest of a table's rows in any order: exact sums of row hashes."""
    row = cells.agg(F.count("*"), F.sum(F.xxhash64(*sorted(cells.columns)).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{row[0]}:{row[1]}".encode()).hexdigest()


def draft_until_valid(book: FactBook, provider: narrate.Provider, registry: Registry, brief: str, max_retries: int) -> list[dict]:
    """Attempts, each with its text, violations and bindings; the last one passed or retries ran out."""
    spark = book.facts.sparkSession
    document = book.pack_document()
    attempts, violations = [], None
    for _ in range(max_retries + 1):
        try:
            reply = provider.complete(narrate.SYSTEM, narrate.user_prompt(document, brief, violations))
        except narrate.ProviderError:
            raise
        except Exception as e:
            raise narrate.ProviderError(str(e)) from e
        drafts = spark.createDataFrame([("draft", reply.text)], "draft_id string, text string")
        broken, bindings = binding.validate(drafts, book.facts, book.pack, book.shortlist, registry, book.plan)
        violations = [{k: v for k, v in r.asDict().items() if v is not None and k != "draft_id"} for r in broken.orderBy("highlight", "claim", "code").collect()]
        attempts.append({
            "text": reply.text, "provider": reply.provider, "model": reply.model, "response_sha256": hashlib.sha256(reply.text.encode()).hexdigest(),
            "violations": violations, "claims": [json.loads(r["audit"]) for r in audit.claim_trail(drafts, bindings, book.facts).orderBy("highlight", "claim").collect()],
        })
        if not violations:
            break
    return attempts


def facts_head(book: FactBook, name: str) -> dict:
    """What the file of facts says besides facts; bounded by the registry and the shortlist."""
    plan, days = book.plan, lambda span: {"start": span.start.isoformat(), "end": span.end.isoformat()}
    listed = book.shortlist.select("rank", "metric_id", "cut", "channels", "fact_ids").orderBy("rank").collect()
    return {
        "run_id": name, "as_of": plan.as_of.isoformat(), "week_in_review": days(plan.week), "partial_week": days(plan.running) if plan.running else None,
        "incomplete": book.incomplete, "coverage": book.coverage, "shortlist": [r.asDict() for r in listed],
    }


def run(cells: DataFrame, registry: Registry, spec: SourceSpec, config: RunConfig, provider: narrate.Provider | None = None, source_sha256: str | None = None) -> int:
    """Write facts, pack, audit and report under ``config.out``; the exit code tells how it went.

    ``source_sha256`` is the digest of the source's bytes; cells that come from no file are known by a digest of their rows.
    """
    registry.check(spec)
    provider = provider or narrate.DeterministicWriter()
    plan = build_plan(config.as_of, config.weeks_back, config.days_back)
    out = Path(config.out)
    out.mkdir(parents=True, exist_ok=True)
    source_sha256 = source_sha256 or fingerprint(cells)
    name = run_id(config.as_of, source_sha256, registry.sha256)
    book = build_factbook(cells, registry, spec, plan, folder=str(out))
    write_json(book.facts.drop("metric_ord"), "id", "facts", facts_head(book, name), str(out / "facts.json"))
    _write_json(out / "pack.json", book.pack_document())
    attempts = draft_until_valid(book, provider, registry, config.brief, config.max_retries)
    last = attempts[-1]
    _write_json(out / "audit.json", {
        "run_id": name, "source_sha256": source_sha256, "registry_sha256": registry.sha256, "attempts": [{k: v for k, v in a.items() if k != "text"} for a in attempts], "coverage": book.coverage,
    })
    if last["violations"]:
        return REFUSED
    bound = {(c["highlight"], c["claim"]): {"fact_id": c["fact_id"], "display": c["display"], "formula": c["derivation"][0]["formula"]} for c in last["claims"]}
    items = {r["rank"]: r.asDict() for r in book.shortlist.select("rank", "metric_id", "cut").collect()}
    head = {"week_start": plan.week.start, "week_end": plan.week.end, "as_of": config.as_of, "run_id": name, "incomplete": book.incomplete,
            "coverage": book.coverage, "writer": last["model"], "attempts": len(attempts)}
    text, _ = render.report(binding.parse_draft(last["text"]), head, bound, items)
    (out / "report.md").write_text(text, encoding="utf-8")
    return INCOMPLETE if book.incomplete else OK


def _write_json(path: Path, value) -> None:
    path.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
