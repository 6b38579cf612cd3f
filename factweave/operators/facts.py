"""Records to facts: one row a series with every comparison, then one row a published number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import numbers as N
from factweave.functions import stats as S
from factweave.plans.calendar import ReportPlan, Span
from factweave.plans.spec import Registry

PCT_PRECISION, SCORE_PRECISION = 1, 2
OVERALL = "overall"

LABELS = {
    "value": "value", "n_obs": "observations", "wow_delta": "week-over-week change", "wow_pct": "week-over-week change, percent",
    "baseline_mean": "mean of prior weeks", "vs_baseline_pct": "change against prior weeks, percent", "screening_z": "screening z",
    "numerator": "numerator", "denominator": "denominator", "rate_z": "two-proportion z", "contribution_share_pct": "share of the overall change, percent",
    "weekday_median": "median of prior same weekdays", "robust_scale": "robust scale", "robust_score": "robust score",
    "slice_baseline_mean": "mean of the same slice of prior weeks", "vs_slice_pct": "change against the same slice, percent",
}


def series(records: DataFrame) -> DataFrame:
    """One row per metric and segment; ``at`` maps a period's label to its record."""
    record = F.struct("value", "numerator", "denominator", "n_obs", "provenance", "flags")
    return records.groupBy("metric_ord", "metric_id", "metric_type", "statistic", "cut", "cut_dim", "cut_value").agg(
        F.map_from_entries(F.collect_list(F.struct("period_label", record))).alias("at")
    )


def _at(period: Span | Column, field: str) -> Column:
    label = F.lit(period.label) if isinstance(period, Span) else period
    return F.try_element_at(F.col("at"), label)[field]


def _values(periods) -> Column:
    return F.array(*[_at(p, "value") for p in periods]) if periods else F.array().cast("array<double>")


def _day_table(plan: ReportPlan) -> Column:
    """Literal array of the week's days with the labels of their baselines."""
    return F.array(*[
        F.struct(F.lit(d.label).alias("label"), F.lit(d.end).alias("day"), F.array(*[F.lit(b.label) for b in d.earlier(plan.days_back)]).alias("before"))
        for d in plan.days
    ])


def compared(records: DataFrame, registry: Registry, plan: ReportPlan) -> DataFrame:
    """Per series: structs ``week``, ``days`` (array) and ``part`` with every statistic.

    Grouping records by series is the only shuffle; periods of a plan are few,
    so a series is one small row.
    """
    w, prior = plan.week, plan.earlier_weeks[0] if plan.earlier_weeks else None
    prior_of = lambda f: _at(prior, f) if prior else F.lit(None).cast("double")
    value, before = _at(w, "value"), prior_of("value")
    rate = F.col("statistic") == "rate"
    ratio = rate | (F.col("statistic") == "mean")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    num, den = _at(w, "numerator"), _at(w, "denominator")
    filled = lambda p: F.coalesce(_at(p, "provenance") == "zero_fill", F.lit(False))
    all_filled = F.lit(bool(plan.earlier_weeks))
    for p in plan.earlier_weeks:
        all_filled = all_filled & filled(p)
    week = F.struct(
        value.alias("value"), _at(w, "n_obs").alias("n_obs"), S.delta(value, before).alias("wow_delta"), S.pct_change(value, before).alias("wow_pct"),
        S.compare_to_baseline(value, _values(plan.earlier_weeks)).alias("base"), num.alias("numerator"), den.alias("denominator"),
        F.when(rate, S.rate_adequacy_flags(num, zero(den))).otherwise(F.array().cast(S.NO_FLAGS)).alias("adequacy"),
        F.when(rate & F.lit(prior is not None), S.two_proportion_z(num, zero(den), prior_of("numerator"), zero(prior_of("denominator")))).alias("rate_z"),
        filled(w).alias("disappeared"), (~filled(w) & all_filled).alias("newly_appeared"),
    )
    days = F.transform(_day_table(plan), lambda d: F.struct(
        d["label"].alias("label"), d["day"].alias("day"), _at(d["label"], "value").alias("value"), _at(d["label"], "flags").alias("flags"), d["before"].alias("before"),
        S.robust_score(_at(d["label"], "value"), F.transform(d["before"], lambda b: _at(b, "value")), F.col("metric_type")).alias("robust"),
    ))
    if plan.running:
        part = F.struct(_at(plan.running, "value").alias("value"), S.compare_to_baseline(_at(plan.running, "value"), _values(plan.earlier_slices)).alias("base"))
    else:
        part = F.lit(None).cast("struct<value:double>")
    units = {m.id: m for m in registry.metrics}
    by_metric = lambda f: F.element_at(F.create_map(*[x for i, m in units.items() for x in (F.lit(i), F.lit(f(m)))]), F.col("metric_id"))
    out = series(records).select("*", week.alias("week"), days.alias("days"), part.alias("part"), ratio.alias("is_ratio"),
                                 by_metric(lambda m: m.unit).alias("unit"), by_metric(lambda m: m.display_precision).alias("precision"),
                                 by_metric(lambda m: m.title).alias("title"), by_metric(lambda m: m.formula).alias("formula"),
                                 by_metric(lambda m: m.n_obs_field).alias("n_obs_field"), by_metric(lambda m: m.numerator_field).alias("numerator_field"),
                                 by_metric(lambda m: m.denominator_field or "").alias("denominator_field"))
    of = lambda p: F.max(F.when(F.col("period_label") == p.label, F.col("value"))) if p else F.lit(None).cast("double")
    overall = records.where(F.col("cut_dim").isNull()).groupBy(F.col("metric_id").alias("o_metric")).agg((of(w) - of(prior)).alias("overall_delta"))
    joined = out.join(overall, F.col("metric_id") == F.col("o_metric"), "left").drop("o_metric")
    share = F.when(F.col("cut_dim").isNotNull() & ~F.col("is_ratio"), S.contribution_share(F.col("week.wow_delta"), F.col("overall_delta")))
    return joined.withColumn("share", share)


def fact_id(label: Column | str, statistic: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws("/", "metric_id", "cut", text(label), text(statistic))


def _ids(periods) -> Column:
    return F.array(*[fact_id(p.label, "value") for p in periods]) if periods else F.array().cast("array<string>")


def _fact(keep, statistic: str, period, value: Column, *, unit=None, precision=None, flags=None, computation=None, formula=None, inputs=None, note="") -> Column:
    """Struct of one published number; ``period`` is a Span or a struct of label and day."""
    fixed = isinstance(period, Span)
    label = F.lit(period.label) if fixed else period["label"]
    col = lambda x, default: default if x is None else F.lit(x) if isinstance(x, (str, int)) else x
    return F.struct(
        F.lit(keep).alias("keep") if isinstance(keep, bool) else keep.alias("keep"), F.lit(statistic).alias("statistic_key"),
        label.alias("period_label"), (F.lit(period.phrase) if fixed else F.concat(F.lit("day "), period["day"].cast("string"))).alias("phrase"), F.lit(period.kind if fixed else "daily").alias("period_type"),
        (F.lit(period.start) if fixed else period["day"]).alias("period_start"), (F.lit(period.end) if fixed else period["day"]).alias("period_end"),
        value.cast("double").alias("value"), col(unit, F.col("unit")).alias("unit"), col(precision, F.col("precision")).cast("int").alias("display_precision"),
        F.coalesce(flags if flags is not None else F.lit(None).cast(S.NO_FLAGS), F.array().cast(S.NO_FLAGS)).alias("flags"),
        F.lit(computation or "aggregate").alias("computation"), col(formula, F.col("formula")).alias("formula"),
        (inputs if inputs is not None else F.array().cast("array<string>")).alias("inputs"), F.lit(note).alias("note"),
    )


def _rows_of(period: Span) -> Column:
    days = period.end.isoformat() if period.start == period.end else f"{period.start.isoformat()}..{period.end.isoformat()}"
    return F.array(F.lit(f"source_rows:{days}"))


def facts(wide: DataFrame, plan: ReportPlan) -> DataFrame:
    """One row per published number, with id, display, flags and provenance."""
    w, bases = plan.week, plan.earlier_weeks
    own, base_ids = F.array(fact_id(w.label, "value")), _ids(bases)
    pair = F.concat(own, _ids(bases[:1]))
    base = F.col("week.base")
    points = F.when(F.col("unit") == "percent", "pp").otherwise(F.col("unit"))
    pct = {"unit": "percent", "precision": PCT_PRECISION}
    score = {"unit": "score", "precision": SCORE_PRECISION}
    count = {"unit": "count", "precision": 0}
    cut_share = F.col("cut_dim").isNotNull() & ~F.col("is_ratio")
    rate = F.col("statistic") == "rate"
    adequacy = F.col("week.adequacy")
    weekly = [
        _fact(True, "value", w, F.col("week.value"), flags=_at(w, "flags"), inputs=_rows_of(w), note="sum of the source rows of the period"),
        _fact(True, "n_obs", w, F.col("week.n_obs"), formula=F.concat(F.lit("SUM("), "n_obs_field", F.lit(") over the period")), inputs=_rows_of(w), **count),
        *[_fact(True, "value", p, _at(p, "value"), flags=_at(p, "flags"), inputs=_rows_of(p), note="an earlier week") for p in bases],
        _fact(True, "wow_delta", w, F.col("week.wow_delta"), unit=points, computation="wow_delta", formula="current - prior_week", inputs=pair),
        _fact(True, "wow_pct", w, F.col("week.wow_pct"), computation="wow_pct", formula="100 * (current - prior_week) / |prior_week|", inputs=pair, **pct),
        _fact(True, "baseline_mean", w, base["mean"], flags=base["flags"], computation="baseline_mean", formula=f"mean of {len(bases)} prior complete weeks", inputs=base_ids),
        _fact(True, "vs_baseline_pct", w, base["pct"], flags=base["flags"], computation="vs_baseline_pct", formula="100 * (current - baseline_mean) / |baseline_mean|", inputs=F.concat(own, base_ids), **pct),
        _fact(True, "screening_z", w, base["z"], flags=base["flags"], computation="screening_z", formula="(current - baseline_mean) / sample sd of the baseline", inputs=F.concat(own, base_ids), note="ranks series; no p-value", **score),
        _fact(F.col("is_ratio"), "numerator", w, F.col("week.numerator"), flags=adequacy, formula=F.concat(F.lit("SUM("), "numerator_field", F.lit(")")), inputs=_rows_of(w), **count),
        _fact(F.col("is_ratio"), "denominator", w, F.col("week.denominator"), flags=adequacy, formula=F.concat(F.lit("SUM("), "denominator_field", F.lit(")")), inputs=_rows_of(w), **count),
        _fact(rate, "rate_z", w, F.col("week.rate_z"), flags=adequacy, computation="two_proportion_z", formula="(p1 - p2) / sqrt(p (1 - p) (1/n1 + 1/n2)), p pooled", inputs=pair, note="visitors return, so this only screens", **score),
        _fact(cut_share, "contribution_share_pct", w, F.col("share"), computation="contribution_share_pct", formula="100 * segment change / overall change",
              inputs=F.array(fact_id(w.label, "wow_delta"), F.concat_ws("/", "metric_id", F.lit(OVERALL), F.lit(w.label), F.lit("wow_delta"))), note="sums only: means don't decompose", **pct),
    ]
    blocks = [F.array(*weekly)]
    if plan.days:
        blocks.append(F.flatten(F.transform("days", lambda d: F.array(*_daily(d)))))
        before = [p for p in sorted({p for d in plan.days for p in d.earlier(plan.days_back)}) if p not in plan.days]
        if before:
            blocks.append(F.array(*[_fact(True, "value", p, _at(p, "value"), flags=_at(p, "flags"), inputs=_rows_of(p)) for p in before]))
    if plan.running:
        p, slices = plan.running, plan.earlier_slices
        part, ids = F.col("part.base"), _ids(slices)
        blocks.append(F.array(
            *[_fact(True, "value", s, _at(s, "value"), flags=_at(s, "flags"), inputs=_rows_of(s), note="the same days of an earlier week") for s in slices],
            _fact(True, "value", p, F.col("part.value"), flags=_at(p, "flags"), inputs=_rows_of(p), note="the running week up to its last complete day"),
            _fact(True, "slice_baseline_mean", p, part["mean"], flags=part["flags"], computation="slice_baseline_mean", formula="mean of the same days of prior weeks", inputs=ids, note="never against a whole week"),
            _fact(True, "vs_slice_pct", p, part["pct"], flags=part["flags"], computation="vs_slice_pct", formula="100 * (current - slice_baseline_mean) / |slice_baseline_mean|", inputs=F.concat(F.array(fact_id(p.label, "value")), ids), **pct),
        ))
    long = wide.select("metric_ord", "metric_id", "title", "cut", "cut_dim", "cut_value", F.explode(F.filter(F.concat(*blocks), lambda f: f["keep"])).alias("f"))
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    f = long.select("metric_ord", "metric_id", "title", "cut", "cut_dim", "cut_value", "f.*").drop("keep")
    return f.select(
        fact_id(F.col("period_label"), F.col("statistic_key")).alias("id"), "metric_ord", "metric_id",
        F.concat_ws(" | ", "title", "cut", "phrase", F.element_at(names, F.col("statistic_key"))).alias("label"),
        "statistic_key", "cut", "cut_dim", "cut_value", "period_label", "period_type", "period_start", "period_end", "value", "unit", "display_precision",
        N.format_value(F.col("value"), F.col("unit"), F.col("display_precision")).alias("display"), "flags",
        F.struct("computation", "formula", "inputs", "note").alias("provenance"),
    )


def _daily(d: Column) -> list[Column]:
    r = d["robust"]
    own = F.array(fact_id(d["label"], "value"))
    ids = F.transform(d["before"], lambda b: fact_id(b, "value"))
    return [
        _fact(True, "value", d, d["value"], flags=d["flags"], inputs=F.array(F.concat(F.lit("source_rows:"), d["day"].cast("string")))),
        _fact(True, "weekday_median", d, r["median"], flags=r["flags"], computation="weekday_median", formula="median of the prior same weekdays", inputs=ids),
        _fact(True, "robust_scale", d, r["scale"], flags=r["flags"], computation="robust_scale",
              formula="max(1.4826 * MAD, floor); floor = sqrt(max(median, 1)) for counts, 0.01 * |median| else", inputs=ids, note="a floor only widens"),
        _fact(True, "robust_score", d, r["score"], flags=r["flags"], computation="robust_score", formula="(value - weekday_median) / robust_scale",
              inputs=F.concat(own, ids), note="no score where all of the baseline is zero", unit="score", precision=SCORE_PRECISION),
    ]
