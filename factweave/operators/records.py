"""Cells to canonical records: one row per metric, segment and period, on a dense grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import stats as S
from factweave.plans.calendar import ReportPlan, days_frame, span_days_frame, spans_frame
from factweave.plans.spec import Metric, Registry, SourceSpec
from factweave.sources.cells import EXACT

OVERALL = "overall"
FRESHNESS_SLACK_DAYS = 1
#: Stands for a null label in the name of its segment; no label of a source may hold it.
NO_LABEL = "\\N"


def day_segments(cells: DataFrame, spec: SourceSpec, plan: ReportPlan) -> DataFrame:
    """Sums per day for the total and for each value of each single dimension, in one pass.

    Cells outside the plan are filtered before, so the filter reaches the
    scan; what leaves is a row per day and segment, whatever the cells are.
    """
    start, end = plan.reach
    rows = cells.where(F.col("day").between(F.lit(start), F.lit(end)))
    sets = [["day"], *(["day", d] for d in spec.dims)]
    grouped = rows.groupingSets(sets, "day", *spec.dims).agg(
        *[F.grouping(d).alias(f"g{i}") for i, d in enumerate(spec.dims)], *[F.sum(F.col(m).cast(EXACT)).alias(m) for m in spec.measures])
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(spec.dims):
        dim = F.when(F.col(f"g{i}") == 0, F.lit(d)).otherwise(dim)
        value = F.when(F.col(f"g{i}") == 0, F.col(d)).otherwise(value)
    cut = F.when(dim.isNull(), F.lit(OVERALL)).otherwise(F.concat(dim, F.lit("="), F.coalesce(value, F.lit(NO_LABEL))))
    return grouped.select("day", dim.alias("cut_dim"), value.alias("cut_value"), cut.alias("cut"), *spec.measures)


def period_sums(segments: DataFrame, spec: SourceSpec, plan: ReportPlan) -> DataFrame:
    """Sums per period and segment: days meet their periods by an equi-join with the plan's few hundred rows."""
    days = F.broadcast(span_days_frame(segments.sparkSession, plan))
    return segments.join(days, "day").groupBy("period_label", "cut", "cut_dim", "cut_value").agg(*[F.sum(m).alias(m) for m in spec.measures])


def segment_universe(segments: DataFrame) -> DataFrame:
    """Segments seen on any planned day."""
    return segments.select("cut", "cut_dim", "cut_value").distinct()


def grid_sums(sums: DataFrame, universe: DataFrame, spec: SourceSpec, plan: ReportPlan) -> DataFrame:
    """Every segment in every period; those without rows get zeros and ``filled``."""
    periods = F.broadcast(spans_frame(sums.sparkSession, plan))
    present = sums.select("period_label", "cut", *spec.measures, F.lit(True).alias("__present"))
    grid = universe.crossJoin(periods).join(present, ["period_label", "cut"], "left")
    return grid.select(
        "cut", "cut_dim", "cut_value", "period_label", "period_type", "period_start", "period_end",
        F.col("__present").isNull().alias("filled"), *[F.coalesce(F.col(m), F.lit(0)).cast("double").alias(m) for m in spec.measures],
    )


def metric_record(metric: Metric, place: int):
    """Struct of one metric's record from a row of sums: null without exposure, never zero."""
    top = F.col(metric.numerator_field)
    bottom = F.col(metric.denominator_field) if metric.is_ratio else F.lit(None).cast("double")
    value = F.try_divide(top, bottom) * (100.0 if metric.statistic == "rate" else 1.0) if metric.is_ratio else top
    no_exposure = (bottom == 0) if metric.is_ratio else F.lit(False)
    return F.struct(
        F.lit(place).alias("metric_ord"), F.lit(metric.id).alias("metric_id"), F.lit(metric.metric_type).alias("metric_type"),
        F.lit(metric.statistic).alias("statistic"), value.alias("value"), top.alias("numerator"), bottom.alias("denominator"),
        F.col(metric.n_obs_field).alias("n_obs"), S.flags((no_exposure, "no_exposure"), (F.col("filled"), "zero_filled")).alias("flags"),
        F.array(F.lit(""), *[F.lit(c) for c in metric.cuts]).alias("cuts"),
    )


def records(cells: DataFrame, registry: Registry, spec: SourceSpec, plan: ReportPlan) -> DataFrame:
    """Canonical records of every metric on the dense grid of its cuts."""
    registry.check(spec)
    segments = day_segments(cells, spec, plan)
    grid = grid_sums(period_sums(segments, spec, plan), segment_universe(segments), spec, plan)
    each = F.explode(F.array(*[metric_record(m, i) for i, m in enumerate(registry.metrics)]))
    keep = F.array_contains("m.cuts", F.coalesce("cut_dim", F.lit("")))
    return grid.select("*", each.alias("m")).where(keep).select(
        "m.metric_ord", "m.metric_id", "m.metric_type", "m.statistic", F.when(F.col("cut_dim").isNull(), OVERALL).otherwise("cut").alias("grain"),
        "cut", "cut_dim", "cut_value", "period_label", "period_type", "period_start", "period_end", "m.value", "m.numerator", "m.denominator",
        "m.n_obs", F.when(F.col("filled"), "zero_fill").otherwise("query").alias("provenance"), "m.flags",
    )


def missing_days(cells: DataFrame, plan: ReportPlan) -> DataFrame:
    """Planned days without any cell."""
    return days_frame(cells.sparkSession, plan).join(cells.select("day").distinct(), "day", "left_anti")


def coverage(cells: DataFrame, registry: Registry, plan: ReportPlan) -> DataFrame:
    """Per metric: ok, incomplete (planned days are missing) or stale (the newest day is too old; checked first)."""
    spark = cells.sparkSession
    newest = cells.agg(F.max("day").alias("newest"))
    gaps = missing_days(cells, plan).agg(F.count("*").alias("n_missing"), F.min("day").alias("first_missing"))
    stale = F.coalesce(F.col("newest") < F.date_sub(F.lit(plan.as_of), 1 + FRESHNESS_SLACK_DAYS), F.lit(True))
    metrics = spark.createDataFrame([(m.id, m.required) for m in registry.metrics], "metric_id string, required boolean")
    detail = F.when(stale, F.concat(F.lit("newest day is "), F.coalesce(F.col("newest").cast("string"), F.lit("missing")))).when(
        F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" days missing, first "), F.col("first_missing").cast("string"))
    ).otherwise("")
    return metrics.crossJoin(newest).crossJoin(gaps).select(
        "metric_id", F.when(stale, "stale").when(F.col("n_missing") > 0, "incomplete").otherwise("ok").alias("status"), "required", detail.alias("detail"),
    )
