"""The way back: from claims to facts to what the facts were computed from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.binding import highlights
from factweave.sources.json_file import canonical_json


def provenance_edges(facts: DataFrame) -> DataFrame:
    """(id, input): facts or ``source_rows:`` leaves."""
    return facts.select("id", F.explode("provenance.inputs").alias("input"))


def provenance_closure(facts: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, depth): facts reached from each root, itself at 0, within ``depth`` levels; the least depth counts."""
    edges = provenance_edges(facts).where(~F.col("input").startswith("source_rows:"))
    level = roots.select(F.col("id").alias("root"), F.col("id"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth):
        level = level.join(edges, "id").select("root", F.col("input").alias("id"), F.lit(d).alias("depth")).distinct()
        out = out.unionByName(level)
    return out.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def unresolved_inputs(facts: DataFrame) -> DataFrame:
    """Inputs that are neither a fact nor source rows; always empty for facts of one run."""
    edges = provenance_edges(facts).where(~F.col("input").startswith("source_rows:"))
    return edges.join(facts.select(F.col("id").alias("input")), "input", "left_anti")


def derivations(facts: DataFrame, cited: DataFrame, depth: int = 3) -> DataFrame:
    """(id, derivation): what each cited fact was computed from, itself first, then level by level in the order of ids.

    A fact has a bounded number of inputs, and there are ``depth`` levels, so a derivation is one small row.
    """
    known = cited.select("id").distinct().join(facts.select("id"), "id")
    steps = provenance_closure(facts, known, depth).join(facts.select("id", "provenance", "flags"), "id")
    step = F.struct("depth", F.col("id").alias("fact_id"), "provenance.computation", "provenance.formula", "provenance.inputs", "provenance.note", "flags")
    listed = steps.groupBy("root").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    own = lambda s: F.struct(*[s[f].alias(f) for f in ("fact_id", "computation", "formula", "inputs", "note", "flags")])
    return listed.select(F.col("root").alias("id"), F.transform("steps", own).alias("derivation"))


def claim_trail(drafts: DataFrame, bindings: DataFrame, facts: DataFrame) -> DataFrame:
    """draft_id, highlight, claim, audit: per binding one JSON object with sorted keys, from the claim back to the source rows.

    A claim on an unknown fact has nulls for what facts have, and an empty derivation.
    """
    found = derivations(facts, bindings.select(F.col("fact_id").alias("id"))).join(facts, "id")
    fact = found.select(F.col("id").alias("fact_id"), F.col("label").alias("fact_label"), "display", "unit", "derivation",
                        F.struct(F.col("period_type").alias("type"), F.col("period_start").alias("start"), F.col("period_end").alias("end")).alias("period"))
    told = highlights(drafts).select("draft_id", "highlight", F.col("title").alias("highlight_title"), "metric_id")
    rows = bindings.withColumnsRenamed({"claimed": "claimed_value", "computed": "computed_value"}).join(fact, "fact_id", "left").join(told, ["draft_id", "highlight"], "left")
    rows = rows.withColumn("derivation", F.coalesce("derivation", F.array().cast(rows.schema["derivation"].dataType)))
    names = ("highlight", "claim", "fact_id", "status", "claimed_value", "computed_value", "tolerance", "highlight_title", "metric_id", "fact_label", "display", "unit", "period", "derivation")
    return rows.select("draft_id", "highlight", "claim", canonical_json(rows, *names).alias("audit"))
