"""Which series of a report become stories: candidates by fixed thresholds, and a choice under caps.

The choice depends on order: the weightiest candidate is told first, and each
one told uses up room of its metric, its segment and its day.  That is a fold
over the at most a hundred ranked rows of a report, done by an expression on
the report's one row, so any number of reports is decided in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.shortlist import dismissal_reason, severity
from factweave.plans.calendar import ReportPlan

#: From where on a series is news, its weight, and how many stories a report holds.
DAY_NEWS, WEEK_Z, WEEK_PCT, MATERIAL_PCT = 6.0, 2.5, 8.0, 3.0
MOST, MOST_PER_METRIC, MOST_PER_CUT, MOST_PER_DAY = 6, 3, 1, 1
GONE_WEIGHT, NEW_WEIGHT, WEEK_WEIGHT = 1000.0, 900.0, 20.0
#: Decimals to which weights are compared, so that no last bit decides; equal ones go by rank, equal days by date.
PLACES = 6
TOLD, CROWDED, TOO_MANY = "told", "duplicate-of-highlight", "small-absolute-impact"


def candidates(series: DataFrame) -> DataFrame:
    """``series`` with kind (null: no story), weight, severity, and reason (why it would be passed over).

    Read are channels, value, wow_pct, z, flags, and the day of the greatest
    robust score with that score, where it is news.
    """
    z, pct, known = F.col("z"), F.col("wow_pct"), F.col("value").isNotNull()
    at_least = lambda c, most: F.coalesce(F.abs(c) >= most, F.lit(False))
    in_channel = lambda name: F.array_contains("channels", name)
    weekly = at_least(pct, MATERIAL_PCT) & (at_least(z, WEEK_Z) | at_least(pct, WEEK_PCT))
    kind = F.when(in_channel("disappeared") & known, "disappeared").when(in_channel("newly_appeared") & known, "newly_appeared")
    kind = kind.when(at_least(F.col("score"), DAY_NEWS), "daily").when(weekly, "weekly")
    strength = F.greatest(F.coalesce(F.abs(z), F.lit(0.0)), F.coalesce(F.abs(pct) / 2, F.lit(0.0)))
    by_kind = lambda gone, new, day, week: F.when(F.col("kind") == "disappeared", gone).when(F.col("kind") == "newly_appeared", new).when(F.col("kind") == "daily", day).when(F.col("kind") == "weekly", week)
    return series.withColumn("kind", kind).select(
        *[c for c in series.columns if c != "day"], F.when(F.col("kind") == "daily", F.col("day")).alias("day"), "kind",
        F.round(by_kind(F.lit(GONE_WEIGHT), F.lit(NEW_WEIGHT), F.abs("score"), F.lit(WEEK_WEIGHT) + strength), PLACES).alias("weight"),
        by_kind(F.lit("high"), F.lit("medium"), F.lit("high"), severity(pct, z)).alias("severity"), dismissal_reason(F.col("flags"), pct).alias("reason"))


def of_report(wide: DataFrame, chosen: DataFrame, plan: ReportPlan) -> DataFrame:
    """What ``candidates`` reads, for the shortlisted series of one report."""
    notable = F.filter("days", lambda d: F.coalesce(F.abs(d["robust"]["score"]) >= DAY_NEWS, F.lit(False)))
    extreme = F.array_max(F.transform(notable, lambda d: F.struct(F.round(F.abs(d["robust"]["score"]), PLACES).alias("size"), d["day"].alias("day"), d["robust"]["score"].alias("score"))))
    week = F.col("week")
    series = wide.select("metric_id", "cut", week["value"].alias("value"), week["wow_pct"].alias("wow_pct"), week["base"]["z"].alias("z"),
                         F.try_element_at("at", F.lit(plan.week.label))["flags"].alias("flags"), extreme["day"].alias("day"), extreme["score"].alias("score"))
    return chosen.select("rank", "metric_id", "cut", "channels").join(series, ["metric_id", "cut"])


def _decided(ranked: Column) -> Column:
    """The fold: each candidate in order, with its outcome and how many stories were told before it."""

    def step(done: Column, c: Column) -> Column:
        told = F.filter(done, lambda d: d["outcome"] == TOLD)
        same = lambda f: F.size(F.filter(told, lambda d: d[f] == c[f]))
        crowded = (same("metric_id") >= MOST_PER_METRIC) | (same("cut") >= MOST_PER_CUT) | (same("day") >= MOST_PER_DAY)
        outcome = F.when(crowded, CROWDED).when(F.size(told) >= MOST, TOO_MANY).otherwise(TOLD)
        return F.concat(done, F.array(F.struct(c["rank"].alias("rank"), c["metric_id"].alias("metric_id"), c["cut"].alias("cut"), c["day"].alias("day"), outcome.alias("outcome"), F.size(told).alias("place"))))

    nothing = F.array().cast("array<struct<rank:int,metric_id:string,cut:string,day:date,outcome:string,place:int>>")
    return F.aggregate(ranked, nothing, step)


def select_stories(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of each report with outcome (told, or the reason why not) and place among the told (from 0).

    ``by`` names the columns of a report; rows of a report come in any order and are known by their rank.
    """
    found = candidates(series)
    key = F.struct((-F.col("weight")).alias("first"), F.col("rank").cast("int").alias("rank"), "metric_id", "cut", "day")
    decided = found.where("kind IS NOT NULL").groupBy(*by).agg(F.explode(_decided(F.sort_array(F.collect_list(key)))).alias("d"))
    decided = decided.select(*by, F.col("d.rank").alias("rank"), F.col("d.outcome").alias("outcome"), F.when(F.col("d.outcome") == TOLD, F.col("d.place")).alias("place"))
    out = found.join(decided, [*by, "rank"], "left")
    return out.withColumn("outcome", F.coalesce("outcome", "reason")).select(*by, "rank", "metric_id", "cut", "channels", "kind", "severity", "day", "weight", "outcome", "place")
