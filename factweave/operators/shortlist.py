"""What a writer gets to see: a bounded shortlist of series, and the pack of their facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.facts import fact_id
from factweave.operators.tables import written
from factweave.plans.calendar import ReportPlan
from factweave.plans.spec import Registry

#: Series per dimension, series per channel, and the score from which a day travels.
PER_DIMENSION, PER_CHANNEL, DAY_SCORE = 4, 2, 2.5
WEEKLY_KEYS = (
    "value", "n_obs", "wow_delta", "wow_pct", "baseline_mean", "vs_baseline_pct", "screening_z", "numerator", "denominator", "rate_z",
    "contribution_share_pct",
)
PARTIAL_KEYS = ("value", "slice_baseline_mean", "vs_slice_pct")
DAILY_KEYS = ("value", "weekday_median", "robust_scale", "robust_score")


def pack_ids(plan: ReportPlan):
    """Array of the ids of a series' facts that travel."""
    w = plan.week
    exists = {
        "numerator": F.col("is_ratio"), "denominator": F.col("is_ratio"), "rate_z": F.col("statistic") == "rate",
        "contribution_share_pct": F.col("cut_dim").isNotNull() & ~F.col("is_ratio"),
    }
    ids = [F.when(exists.get(k, F.lit(True)), fact_id(w.label, k)) for k in WEEKLY_KEYS]
    ids += [fact_id(p.label, "value") for p in plan.earlier_weeks[:1]]
    if plan.running:
        ids += [fact_id(plan.running.label, k) for k in PARTIAL_KEYS]
    notable = F.filter("days", lambda d: F.coalesce(F.abs(d["robust"]["score"]) >= DAY_SCORE, F.lit(False)) | F.array_contains(d["robust"]["flags"], "new_event"))
    daily = F.flatten(F.transform(notable, lambda d: F.array(*[fact_id(d["label"], k) for k in DAILY_KEYS])))
    return F.array_distinct(F.concat(F.array_compact(F.array(*ids)), daily))


def listed(rows: DataFrame, registry: Registry, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each report (columns ``by``): totals, and of each dimension up to four series by several channels, ranked.

    ``rows`` has metric_ord, metric_id, cut, cut_dim, cut_value, is_ratio, z and
    impact (sizes, 0 if unknown), disappeared, newly_appeared; other columns
    travel along.  Each channel takes its best by a filter of its own, so
    tasks hand on two rows of a dimension, not all of its segments.
    """
    own = [c for c in rows.columns]
    keys = (*by, "metric_id", "cut")
    cuts = rows.where(F.col("cut_dim").isNotNull())
    within = Window.partitionBy(*by, "metric_id", "cut_dim")

    def best(size: str, channel) -> DataFrame:
        placed = cuts.where(F.col(size) > 0).withColumn("turn", F.row_number().over(within.orderBy(F.desc(size), "cut_value")))
        return placed.where(F.col("turn") <= PER_CHANNEL).select(*own, channel.alias("channel"))

    moved = F.when(F.col("disappeared"), "disappeared").when(F.col("newly_appeared"), "newly_appeared")
    branches = best("z", F.lit("screening_z")).unionAll(best("impact", F.when(F.col("is_ratio"), "wow_pct").otherwise("contribution_share_pct")))
    branches = branches.unionAll(cuts.where("disappeared OR newly_appeared").select(*own, moved.alias("channel")))
    merged = branches.groupBy(*keys).agg(F.array_sort(F.collect_list("channel")).alias("channels"), F.first(F.struct(*[c for c in own if c not in keys])).alias("own")).select(*keys, "own.*", "channels")
    placed = merged.withColumn("place", F.row_number().over(within.orderBy(F.desc(F.size("channels")), F.desc("z"), "cut_value"))).where(F.col("place") <= PER_DIMENSION)
    totals = rows.where(F.col("cut_dim").isNull()).withColumn("channels", F.array(F.lit("overall"))).withColumn("place", F.lit(0))
    both = totals.unionByName(placed)
    dims = F.create_map(*[x for m in registry.metrics for i, d in enumerate(m.cuts) for x in (F.lit(f"{m.id}/{d}"), F.lit(i + 1))]) if any(m.cuts for m in registry.metrics) else None
    dim_ord = F.coalesce(F.try_element_at(dims, F.concat_ws("/", "metric_id", "cut_dim")), F.lit(0)) if dims is not None else F.lit(0)
    order = Window.partitionBy(*by).orderBy("metric_ord", F.when(F.col("cut_dim").isNull(), 0).otherwise(dim_ord), "place")
    return both.withColumn("rank", F.row_number().over(order)).drop("place")


def size_of(c):
    """How large a number is, 0 if unknown; to six decimals, so that ties are ties whatever the last bit."""
    return F.round(F.coalesce(F.abs(c), F.lit(0.0)), 6)


def shortlist(wide: DataFrame, registry: Registry, plan: ReportPlan) -> DataFrame:
    """rank, metric_id, cut, channels, fact_ids of one report; see ``listed``."""
    rows = written(wide.select(
        "metric_ord", "metric_id", "cut", "cut_dim", "cut_value", "is_ratio", size_of(F.col("week.base.z")).alias("z"),
        size_of(F.when(F.col("is_ratio"), F.col("week.wow_pct")).otherwise(F.col("share"))).alias("impact"), "week.disappeared", "week.newly_appeared", pack_ids(plan).alias("fact_ids"),
    ), "sizes")
    return listed(rows, registry).select("rank", "metric_id", "cut", "cut_dim", "cut_value", "channels", "fact_ids")


def pack(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The facts that the shortlist mentions, in order of first mention, without derivations."""
    mentions = chosen.select("rank", F.posexplode("fact_ids").alias("pos", "id")).groupBy("id").agg(F.min(F.struct("rank", "pos")).alias("first"))
    return facts.join(mentions, "id").select(
        "id", "label", "value", "display", "unit", "flags", "metric_id", "cut", F.col("first.rank").alias("rank"), F.col("first.pos").alias("pos")
    )


def cut_labels(packed: DataFrame) -> DataFrame:
    """Segments of each metric that the pack shows."""
    return packed.select("metric_id", "cut").distinct()


def severity(pct, z):
    """high, medium or low by the size of a week's move and its z."""
    return F.when((F.abs(pct) >= 20) | F.coalesce(F.abs(z) >= 3, F.lit(False)), "high").when(
        (F.abs(pct) >= 8) | F.coalesce(F.abs(z) >= 2, F.lit(False)), "medium").otherwise("low")


def dismissal_reason(flags, pct):
    """Why a series needs no highlight: thin history, doubtful data, an ordinary move, or a small one."""
    any_of = lambda *names: F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))
    return F.when(any_of("no_baseline", "thin_baseline"), "insufficient-baseline").when(
        any_of("small_cell", "small_denominator", "no_exposure"), "data-quality").when(
        F.abs(pct) < 8, "within-baseline-variation").otherwise("small-absolute-impact")
