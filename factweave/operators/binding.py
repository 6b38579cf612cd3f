"""Binding drafts to facts: every figure, date and claim of a narrative must lead to a published fact.

Any number of drafts is checked at once: expressions parse each draft and
read its prose, and everything that compares with facts is a join.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import numbers as N
from factweave.functions import stats as S
from factweave.operators.tables import written
from factweave.plans.calendar import ReportPlan
from factweave.plans.spec import Registry

SEVERITIES = ("high", "medium", "low")
#: Reasons by which a series may be passed over.
REASONS = ("within-baseline-variation", "small-absolute-impact", "duplicate-of-highlight", "data-quality", "insufficient-baseline")
REQUIRED = ("title", "metric_id", "cut", "severity", "narrative", "claims")
PROSE = ("title", "narrative", "hypothesis")

# Words that tell why, words that stand for a quantity, and what would not stay plain text.
CAUSAL = (
    r"because|due to|driven by|driving|drove|caused by|causing|caused|as a result of|thanks to|owing to|led to|leading to|"
    r"resulted in|resulting from|explains|explained by|attributable to|triggered by|triggering|sparked|sparking|stems from|"
    r"stemming from|reflects|reflecting|responsible for|blame|blamed on|the impact of|contributed to|prompted by|following a|following the"
)
MAGNITUDE = (
    r"roughly|approximately|about|around|nearly|almost|some|several|dozens|hundreds|thousands|millions|billions|halved|doubled|"
    r"tripled|quadrupled|a (?:half|third|quarter|fifth|tenth)|(?:a|one|two|three|four|five) (?:million|billion|thousand)"
)
MARKUP = (
    r"<\s*[a-zA-Z/!]|javascript:|https?://|!\[|\]\(|\]\[|\b[\w-]+\.(?:com|net|org|io|dev|ai|co|app|xyz|example)\b|"
    r"^\s{0,3}#{1,6}\s|^\s{0,3}[-*+>]\s|^\s{0,3}\d+\.\s"
)
_FENCED = re.compile(r"\A\s*```(?:json)?\s*|\s*```\s*\Z")


def causal_word(text: Column) -> Column:
    """The first causal phrase, or the empty string."""
    return F.regexp_extract(text, rf"(?iU)\b({CAUSAL})\b", 1)


def magnitude_word(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?iU)\b({MAGNITUDE})\b", 1)


def has_markup(text: Column) -> Column:
    return text.rlike(rf"(?imUd){MARKUP}")


class DraftError(ValueError):
    """The draft isn't the agreed JSON object."""


def parse_draft(text: str) -> dict:
    """Highlights and dismissals of a reply; one fence around the JSON is allowed, nothing else."""
    try:
        body = json.loads(_FENCED.sub("", (text or "").strip()))
    except (ValueError, RecursionError) as e:
        raise DraftError(f"not valid JSON: {e}") from None
    if not isinstance(body, dict):
        raise DraftError("not a JSON object")
    for key in ("highlights", "dismissals"):
        if not isinstance(body.setdefault(key, []), list):
            raise DraftError(f"{key} is no list")
    return body


FINDINGS = "array<struct<code:string,message:string,claim:int>>"
#: One row per highlight, dismissal or unreadable draft.
PARSED = {
    "draft_id": "string", "highlight": "int", "metric_id": "string", "cut": "string", "findings": FINDINGS, "claims": "array<struct<claim:int,fact_id:string,value:double>>",
    "tokens": "array<struct<field:string,raw:string,digits:string,kind:string>>", "dates": "array<struct<field:string,date:string>>", "rank": "string",
}


def _part(v: Column, name: str, kind: str = "variant") -> Column:
    """A member of a parsed object: null where it is absent (a JSON null is none of SQL's), or is no ``kind``."""
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _said(v: Column) -> Column:
    """A string as it is, anything else as JSON."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _finding(when: Column, code: str, message: Column | str, claim: Column | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message"), (F.lit(None) if claim is None else claim).cast("int").alias("claim")))


def _prose(highlight: Column, name: str) -> tuple[Column, Column, Column]:
    """(findings, tokens, dates) of one field of a highlight."""
    value, text = _part(highlight, name), F.when(_is(_part(highlight, name), "STRING"), _part(highlight, name, "string"))
    strays, magnitude, causal = N.stray_numerals(text), magnitude_word(text), causal_word(text)
    findings = [
        _finding(value.isNotNull() & ~F.is_variant_null(value) & text.isNull(), "E001", f"{name} must be a string"),
        _finding(has_markup(text), "E040", f"{name} holds markup, a link or a list marker"),
        _finding(magnitude != "", "E024", F.concat(F.lit(f"{name} gives a quantity in words: "), magnitude)),
        _finding(strays != "", "E022", F.concat(F.lit(f"{name} holds numerals outside any figure: "), strays)),
    ]
    if name != "hypothesis":
        findings.append(_finding(causal != "", "E030", F.concat(F.lit(f"{name} tells why: "), causal)))
    tokens = F.transform(N.quoted_figures(text), lambda t: F.struct(F.lit(name).alias("field"), t["raw"].alias("raw"), t["digits"].alias("digits"), t["kind"].alias("kind")))
    dates = F.transform(N.quoted_dates(text), lambda d: F.struct(F.lit(name).alias("field"), d.alias("date")))
    return F.array(*findings), F.coalesce(tokens, F.array().cast(PARSED["tokens"])), F.coalesce(dates, F.array().cast(PARSED["dates"]))


def _highlights(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("draft_id", F.posexplode(_part(F.col("v"), "highlights", "array<variant>")).alias("highlight", "h"))
    h, none = F.col("h"), F.array().cast(FINDINGS)
    missing = F.array_compact(F.array(*[F.when(_part(h, k).isNull(), k) for k in REQUIRED]))
    shape = F.when(~_is(h, "OBJECT"), "a highlight must be an object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    rows = rows.select("draft_id", "highlight", "h", shape.alias("shape"))
    listed = F.coalesce(_part(h, "claims", "array<variant>"), F.array().cast("array<variant>"))
    fine = lambda c: _is(c, "OBJECT") & _part(c, "fact_id").isNotNull() & _part(c, "value").isNotNull()
    claims = F.transform(listed, lambda c, i: F.when(fine(c), F.struct(i.cast("int").alias("claim"), _said(_part(c, "fact_id")).alias("fact_id"), _part(c, "value", "double").alias("value"))))
    broken = F.transform(listed, lambda c, i: _finding(~fine(c), "E001", "a claim needs fact_id and value", i))
    severity = _part(h, "severity")
    own = F.array(
        _finding(~F.coalesce(_is(severity, "STRING") & _part(h, "severity", "string").isin(*SEVERITIES), F.lit(False)), "E003", "severity is none of high, medium, low"),
        _finding(~_is(_part(h, "claims"), "ARRAY"), "E001", "claims must be a list"))
    prose = [_prose(h, name) for name in PROSE]
    whole = F.col("shape").isNull()
    kept = lambda c: F.array_compact(F.when(whole, c).otherwise(F.array()))
    findings = F.when(whole, F.array_compact(F.concat(own, broken, *[f for f, _, _ in prose]))).otherwise(F.array(_finding(F.lit(True), "E001", F.col("shape"))))
    return rows.select(
        "draft_id", "highlight", F.when(whole, _said(_part(h, "metric_id"))).alias("metric_id"), F.when(whole, _said(_part(h, "cut"))).alias("cut"), F.coalesce(findings, none).alias("findings"),
        kept(claims).alias("claims"), kept(F.concat(*[t for _, t, _ in prose])).alias("tokens"), kept(F.concat(*[d for _, _, d in prose])).alias("dates"), F.lit(None).cast("string").alias("rank"))


def _dismissals(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("draft_id", F.explode(_part(F.col("v"), "dismissals", "array<variant>")).alias("d"))
    d, reason, rank = F.col("d"), _part(F.col("d"), "reason_code"), _part(F.col("d"), "shortlist_rank")
    fine = _is(d, "OBJECT") & reason.isNotNull()
    known = F.coalesce(_is(reason, "STRING") & _part(d, "reason_code", "string").isin(*REASONS), F.lit(False))
    number = F.when(_is(rank, "BIGINT") | _is(rank, "DECIMAL") | _is(rank, "DOUBLE"), F.try_variant_get(rank, "$", "double"))
    whole = F.when(number == F.floor(number), F.floor(number).cast("string"))
    findings = F.array_compact(F.array(_finding(~fine, "E001", "a dismissal needs a reason_code"), _finding(fine & ~known, "E050", "reason_code is outside the vocabulary")))
    return rows.select("draft_id", findings.alias("findings"), F.when(fine, F.coalesce(whole, F.to_json(rank), F.lit("null"))).alias("rank"))


def _spread(drafts: DataFrame) -> DataFrame:
    """draft_id and text over all tasks: a file of many drafts may be one small split, and reading drafts is work."""
    spark = drafts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return drafts.select(F.col("draft_id").cast("string").alias("draft_id"), "text").repartition(tasks, "draft_id")


def _whole(drafts: DataFrame) -> DataFrame:
    """draft_id and ``v``, the one JSON value that is all of a draft's text, else null.

    White space and a fence around it are taken off.  The parser stops behind a first value, so the text is set
    between a name and its own digest: the object has just these two members, with that digest, only if the text
    is one value.  Each step is a selection of its own, as its result is read more than once.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\A\s+|\s+\z", "")
    rows = _spread(drafts).select("draft_id", F.regexp_replace(text, r"(?U)\A\s*```(?:json)?\s*|\s*```\s*\z", "").alias("body"))
    rows = rows.select("draft_id", "body", F.sha2("body", 256).alias("digest"))
    rows = rows.select("draft_id", "digest", F.try_parse_json(F.concat(F.lit('{"d":'), "body", F.lit(',"end":"'), "digest", F.lit('"}'))).alias("framed"))
    framed = F.col("framed")
    sealed = (F.size(F.try_variant_get(framed, "$", "map<string,variant>")) == 2) & (_part(framed, "end", "string") == F.col("digest"))
    return rows.select("draft_id", F.when(sealed, _part(framed, "d")).alias("v"))


def highlights(drafts: DataFrame) -> DataFrame:
    """draft_id, highlight and what it says, as text: title, narrative, hypothesis, severity, metric_id, cut; null where it says nothing."""
    names = (*PROSE, "severity", "metric_id", "cut")
    listed = _whole(drafts).select("draft_id", F.posexplode(_part(F.col("v"), "highlights", "array<variant>")).alias("highlight", "h"))
    parts = listed.select("draft_id", "highlight", *[_part(F.col("h"), name).alias(name) for name in names])
    return parts.select("draft_id", "highlight", *[F.when(~F.is_variant_null(name), _said(F.col(name))).alias(name) for name in names])


def read_drafts(drafts: DataFrame) -> DataFrame:
    """Rows of PARSED, one per highlight, dismissal or unreadable draft, from (draft_id, text).

    Drafts are parsed as VARIANT inside the JVM, once: what was parsed is written, as several rules read it.  Stricter than ``parse_draft``:
    NaN, Infinity and an object's repeated names are no JSON.
    """
    v = F.col("v")
    bad = lambda name: _part(v, name).isNotNull() & ~_is(_part(v, name), "ARRAY")
    problem = F.when(v.isNull(), "not valid JSON").when(~_is(v, "OBJECT"), "not a JSON object").when(bad("highlights"), "highlights is no list").when(bad("dismissals"), "dismissals is no list")
    parsed = written(_whole(drafts).withColumn("problem", problem), "parsed")
    fine = parsed.where("problem IS NULL")
    unread = parsed.where("problem IS NOT NULL").select("draft_id", F.array(_finding(F.lit(True), "E001", F.col("problem"))).alias("findings"))
    filled = lambda df, kind, name: F.col(name) if name in df.columns else (F.array() if kind.startswith("array") else F.lit(None)).cast(kind).alias(name)
    empty = lambda df: df.select(*[filled(df, kind, name) for name, kind in PARSED.items()])
    return empty(unread).unionByName(empty(_highlights(fine))).unionByName(empty(_dismissals(fine)))


def bind_claims(parsed: DataFrame, facts: DataFrame, packed: DataFrame) -> DataFrame:
    """Per claim: the fact it names and a status; the first check that fails decides."""
    claims = parsed.select("draft_id", "highlight", "metric_id", "cut", F.explode("claims").alias("c")).select("draft_id", "highlight", "metric_id", "cut", "c.*")
    known = facts.select(
        F.col("id").alias("fact_id"), F.col("metric_id").alias("f_metric"), F.col("cut").alias("f_cut"), F.col("value").alias("computed"), "unit", "display",
        N.tolerance(F.col("display_precision")).alias("tolerance"), "period_start", "period_end",
    )
    shown = packed.select(F.col("id").alias("fact_id"), F.lit(True).alias("shown"))
    rows = claims.join(known, "fact_id", "left").join(shown, "fact_id", "left")
    on_subject = (F.col("metric_id") == F.col("f_metric")) & (F.col("cut") == F.col("f_cut"))
    code = F.when(F.col("f_metric").isNull(), "E010").when(F.col("shown").isNull(), "E011").when(F.col("computed").isNull(), "E013").when(
        ~S.values_match(F.col("value"), F.col("computed"), F.col("tolerance")), "E012").when(~on_subject, "E014")
    status = F.create_map(*[F.lit(x) for kv in (("E010", "dangling"), ("E011", "not_in_pack"), ("E013", "mismatch"), ("E012", "mismatch"), ("E014", "off_subject")) for x in kv])
    return rows.withColumn("code", code).select(
        "draft_id", "highlight", "claim", "fact_id", F.col("value").alias("claimed"), F.when(F.col("f_metric").isNotNull(), F.col("computed")).alias("computed"),
        "tolerance", F.coalesce(F.try_element_at(status, F.col("code")), F.lit("bound")).alias("status"), "code", "unit", "display", "period_start", "period_end",
    )


def validate(drafts: DataFrame, facts: DataFrame, packed: DataFrame, chosen: DataFrame, registry: Registry, plan: ReportPlan) -> tuple[DataFrame, DataFrame]:
    """(violations, bindings) of all drafts; a draft without violations passes.

    Parsed drafts and bindings are read by several rules, so they are written.
    """
    parsed = written(read_drafts(drafts), "drafts")
    bindings = written(bind_claims(parsed, facts, packed), "bindings")
    bound = bindings.where(F.col("status") == "bound")
    none = F.lit(None)

    def found(rows: DataFrame, code, message, claim=None, fact=None) -> DataFrame:
        return rows.select(
            "draft_id", "highlight", (claim if claim is not None else none.cast("int")).alias("claim"), (fact if fact is not None else none.cast("string")).alias("fact_id"),
            (F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
        )

    heads = parsed.where(F.col("metric_id").isNotNull())
    known = F.col("metric_id").isin([m.id for m in registry.metrics])
    labels = packed.select("metric_id", "cut").distinct()
    anchors = bound.groupBy("draft_id", "highlight").agg(F.max(F.col("period_end").between(F.lit(plan.week.start), F.lit(plan.latest))).alias("current"))
    digits = bound.select("draft_id", "highlight", N.normalized_digits(F.col("display")).alias("digits"),
                          F.element_at(F.create_map(*[F.lit(x) for kv in N.UNIT_KINDS.items() for x in kv]), F.col("unit")).alias("own_kind")).distinct()
    tokens = parsed.select("draft_id", "highlight", F.posexplode("tokens").alias("at", "t")).select("draft_id", "highlight", "at", "t.*")
    matched = tokens.join(digits, ["draft_id", "highlight", "digits"], "left").groupBy("draft_id", "highlight", "at", "field", "raw").agg(
        F.max("own_kind").alias("any"), F.max(F.col("own_kind") == F.col("kind")).alias("same"))
    wrong = matched.where(F.col("any").isNull() | ~F.coalesce("same", F.lit(False)))
    limits = bound.select("draft_id", "highlight", F.explode(F.array(F.col("period_start").cast("string"), F.col("period_end").cast("string"))).alias("date")).distinct()
    dates = parsed.select("draft_id", "highlight", F.explode("dates").alias("d")).select("draft_id", "highlight", "d.*")
    ranks = chosen.select(F.col("rank").cast("string").alias("rank"))
    own = parsed.select("draft_id", "highlight", F.explode("findings").alias("f"))
    parts = [
        found(own, F.col("f.code"), F.col("f.message"), F.col("f.claim")),
        found(heads.where(~known), "E002", F.concat(F.lit("unknown metric "), "metric_id")),
        found(heads.where(known).join(labels, ["metric_id", "cut"], "left_anti"), "E004", F.concat(F.lit("no segment shown is "), "cut")),
        found(bindings.where(F.col("code").isNotNull()), F.col("code"), F.concat(F.lit("claim is "), "status"), F.col("claim"), F.col("fact_id")),
        found(anchors.where(~F.col("current")), "E015", "no fact cited lies in the week under review"),
        found(wrong, F.when(F.col("any").isNull(), "E020").otherwise("E023"), F.concat("field", F.lit(": "), "raw", F.when(F.col("any").isNull(), " is no claim's figure").otherwise(" has another unit"))),
        found(dates.join(limits, ["draft_id", "highlight", "date"], "left_anti"), "E021", F.concat("field", F.lit(": "), "date", F.lit(" bounds no fact cited"))),
        found(parsed.where(F.col("rank").isNotNull()).join(ranks, "rank", "left_anti"), "E051", F.concat(F.lit("no rank "), "rank")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, bindings.drop("code", "unit", "display", "period_start", "period_end")
