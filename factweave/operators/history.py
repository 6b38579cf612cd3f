"""Reports of many dates at once: every series' weeks, days and running weeks with their baselines, by window frames.

A report of a Sunday reviews the week before it, so report dates are weeks of
a dense daily grid, and a report of any other day adds the running week.  A
week's baseline is the rows before it; a day's is a range of earlier same
weekdays; a running week is a running sum within its week, whose baseline is
the same weekday's running sums.  One shuffle by segment carries all of it: no
day is joined with the days of its baseline, and no plan is expanded per date.

A segment is in a report if any planned day of that report has a row of it, as
in a report of one date; its grid begins and ends a baseline's length around
its own rows, so rare segments cost what they hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import dates as D
from factweave.functions import numbers as N
from factweave.functions import stats as S
from factweave.operators.facts import PCT_PRECISION, SCORE_PRECISION
from factweave.operators.records import day_segments, metric_record
from factweave.operators.shortlist import listed, size_of
from factweave.operators.stories import DAY_NEWS, PLACES
from factweave.operators.tables import written
from factweave.plans.calendar import COMPLETE, DAILY, PARTIAL
from factweave.plans.spec import Registry, SourceSpec


@dataclass(frozen=True)
class Stretch:
    """The days that reports of ``first`` to ``last`` read."""

    first: date
    last: date
    weeks_back: int = 4
    days_back: int = 8

    @property
    def back(self) -> int:
        return 7 * max(self.weeks_back, self.days_back)

    @property
    def reach(self) -> tuple[date, date]:
        sunday = self.first - timedelta((self.first.weekday() + 1) % 7)
        return sunday - timedelta(7 + self.back), self.last - timedelta(1)


@dataclass(frozen=True)
class History:
    """Tables of all report dates; see ``history``."""

    weeks: DataFrame
    days: DataFrame
    running: DataFrame


def _grid(cells: DataFrame, spec: SourceSpec, stretch: Stretch) -> DataFrame:
    """Every segment on every day of its stretch: sums, filled, week, the running sums of the week and the last day with rows."""
    low, high = (F.lit(d) for d in stretch.reach)
    segments = written(day_segments(cells, spec, stretch), "segments")
    seen = segments.groupBy("cut", "cut_dim", "cut_value").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    begin = F.greatest(low, F.date_sub(D.week_start(F.col("a")), stretch.back))
    end = F.least(high, F.date_add(D.week_start(F.col("b")), stretch.back + 13))
    days = seen.select("cut", "cut_dim", "cut_value", F.explode(F.sequence(begin, end)).alias("day"))
    rows = days.join(segments.select("cut", "day", *spec.measures, F.lit(True).alias("present")), ["cut", "day"], "left").repartition("cut")
    zero = lambda m: F.coalesce(F.col(m), F.lit(0))
    rows = rows.select("cut", "cut_dim", "cut_value", "day", D.week_start(F.col("day")).alias("week"), F.col("present").isNull().alias("filled"), *[zero(m).alias(m) for m in spec.measures])
    past = Window.partitionBy("cut").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy("cut", "week").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "*", F.max(F.when(~F.col("filled"), F.col("day"))).over(past).alias("last_seen"), F.min("filled").over(so_far).alias("r_filled"),
        *[F.sum(m).over(so_far).alias(f"r_{m}") for m in spec.measures])


def _by_metric(rows: DataFrame, registry: Registry, keep: tuple[str, ...]) -> DataFrame:
    """Rows of sums and ``filled`` as records of each metric that is cut so."""
    each = F.explode(F.array(*[metric_record(m, i) for i, m in enumerate(registry.metrics)]))
    shown = rows.select("cut", "cut_dim", "cut_value", *keep, each.alias("m")).where(F.array_contains("m.cuts", F.coalesce("cut_dim", F.lit(""))))
    return shown.select("cut", "cut_dim", "cut_value", *keep, "m.metric_id", "m.metric_type", "m.statistic", "m.value", "m.numerator", "m.denominator", "m.n_obs", "m.flags")


def _before(frame) -> Column:
    """Values of a frame in order, nulls included."""
    return F.transform(F.collect_list(F.struct("value")).over(frame), lambda s: s["value"])


def history(cells: DataFrame, registry: Registry, spec: SourceSpec, stretch: Stretch) -> History:
    """Reports of every day of ``stretch``.

    weeks: a row per Sunday ``as_of``, metric and segment, with every weekly statistic.
    days: the same with a row per day of the week under review.
    running: a row per other ``as_of``, metric and segment: the week of that day up to the day before.
    """
    registry.check(spec)
    grid = _grid(cells, spec, stretch)
    measures = spec.measures
    first, last = F.lit(stretch.first), F.lit(stretch.last)
    weekly = grid.groupBy("cut", "cut_dim", "cut_value", "week").agg(
        F.min("filled").alias("filled"), F.max("last_seen").alias("last_seen"), *[F.sum(m).cast("double").alias(m) for m in measures])
    series = Window.partitionBy("cut", "metric_id").orderBy("week")
    rows = _by_metric(weekly, registry, ("week", "last_seen", "filled")).withColumn("prior", F.lag(F.struct("value", "numerator", "denominator")).over(series))
    frame = series.rowsBetween(-stretch.weeks_back, -1)
    rows = rows.withColumn("before", _before(frame)).withColumn("fresh", ~F.col("filled") & F.coalesce(F.min("filled").over(frame), F.lit(False)))
    value, prior, rate = F.col("value"), F.col("prior"), F.col("statistic") == "rate"
    as_of = F.date_add("week", 7)
    planned = (F.col("last_seen") >= F.date_sub("week", stretch.back)) & as_of.between(first, last)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    weeks = rows.where(planned).select(
        as_of.alias("as_of"), "metric_id", "statistic", "cut", "cut_dim", "cut_value", "week", "value", "n_obs", "numerator", "denominator", "flags", F.col("filled").alias("disappeared"), F.col("fresh").alias("newly_appeared"),
        S.delta(value, prior["value"]).alias("wow_delta"), S.pct_change(value, prior["value"]).alias("wow_pct"), S.compare_to_baseline(value, F.col("before")).alias("base"),
        F.when(rate, S.rate_adequacy_flags(F.col("numerator"), zero(F.col("denominator")))).otherwise(F.array().cast(S.NO_FLAGS)).alias("adequacy"),
        F.when(rate, S.two_proportion_z(F.col("numerator"), zero(F.col("denominator")), prior["numerator"], zero(prior["denominator"]))).alias("rate_z"))
    weeks = written(weeks, "weeks")
    overall = weeks.where("cut_dim IS NULL").select(F.col("metric_id").alias("o_metric"), F.col("week").alias("o_week"), F.col("wow_delta").alias("overall_delta"))
    joined = weeks.join(overall, (F.col("metric_id") == F.col("o_metric")) & (F.col("week") == F.col("o_week")), "left").drop("o_metric", "o_week")
    share = F.when(F.col("cut_dim").isNotNull() & ~F.col("statistic").isin("rate", "mean"), S.contribution_share(F.col("wow_delta"), F.col("overall_delta")))

    number = F.datediff("day", F.lit(date(1970, 1, 4)))
    back = lambda n: Window.partitionBy("cut", "metric_id", "weekday").orderBy("n").rangeBetween(-7 * n, -7)
    by_weekday = lambda df: df.withColumn("n", number).withColumn("weekday", F.pmod("n", F.lit(7)))
    seen = F.max("last_seen").over(Window.partitionBy("cut", "week"))
    daily = grid.select("cut", "cut_dim", "cut_value", "day", "week", "filled", seen.alias("last_seen"), *[F.col(m).cast("double").alias(m) for m in measures])
    daily = by_weekday(_by_metric(daily, registry, ("day", "week", "last_seen"))).withColumn("before", _before(back(stretch.days_back)))
    days = daily.where(planned).select(
        as_of.alias("as_of"), "metric_id", "statistic", "cut", "cut_dim", "day", "value", "flags", S.robust_score(value, F.col("before"), F.col("metric_type")).alias("robust"))

    partly = grid.select("cut", "cut_dim", "cut_value", "day", "week", F.col("r_filled").alias("filled"), "last_seen", *[F.col(f"r_{m}").cast("double").alias(m) for m in measures])
    partly = by_weekday(_by_metric(partly, registry, ("day", "week", "last_seen"))).withColumn("before", _before(back(stretch.weeks_back)))
    tomorrow = F.date_add("day", 1)
    reported = (F.col("weekday") < 6) & (F.col("last_seen") >= F.date_sub("week", 7 + stretch.back)) & tomorrow.between(first, last)
    running = partly.where(reported).select(
        tomorrow.alias("as_of"), "metric_id", "statistic", "cut", "cut_dim", "week", "day", "value", "flags", S.compare_to_baseline(value, F.col("before")).alias("base"))
    return History(joined.withColumn("share", share).drop("overall_delta"), days, running)


def history_shortlist(found: History, registry: Registry) -> DataFrame:
    """The shortlist of every Sunday's report: as_of, rank, metric_id, cut, channels, and what ``stories`` asks of a series."""
    ratio = F.col("statistic").isin("rate", "mean")
    places = F.create_map(*[x for i, m in enumerate(registry.metrics) for x in (F.lit(m.id), F.lit(i))])
    rows = found.weeks.select(
        "as_of", F.element_at(places, F.col("metric_id")).alias("metric_ord"), "metric_id", "cut", "cut_dim", "cut_value", ratio.alias("is_ratio"), size_of(F.col("base.z")).alias("z"),
        size_of(F.when(ratio, F.col("wow_pct")).otherwise(F.col("share"))).alias("impact"), "disappeared", "newly_appeared",
        "value", "wow_pct", F.col("base.z").alias("week_z"), "flags")
    chosen = listed(written(rows, "sizes"), registry, ("as_of",))
    day = F.when(F.abs("robust.score") >= DAY_NEWS, F.struct(F.round(F.abs("robust.score"), PLACES).alias("size"), "day", "robust.score"))
    days = found.days.groupBy("as_of", "metric_id", "cut").agg(F.max(day).alias("extreme"))
    return chosen.join(days, ["as_of", "metric_id", "cut"], "left").select(
        "as_of", "rank", "metric_id", "cut", "channels", "value", "wow_pct", F.col("week_z").alias("z"), "flags", "extreme.day", "extreme.score")


def history_facts(found: History, registry: Registry) -> DataFrame:
    """The facts of each report's own periods: as_of, id, value, unit, display_precision, display, flags.

    Facts of earlier periods are those of the earlier reports.
    """
    by = lambda f: F.element_at(F.create_map(*[x for m in registry.metrics for x in (F.lit(m.id), F.lit(f(m)))]), F.col("metric_id"))
    unit, precision = by(lambda m: m.unit), by(lambda m: m.display_precision)
    points = F.when(unit == "percent", "pp").otherwise(unit)
    none = F.array().cast(S.NO_FLAGS)

    def fact(key: str, value: Column, flags: Column = none, unit: Column = unit, precision: Column | int = precision, keep: Column | bool = True) -> Column:
        return F.struct((F.lit(keep) if isinstance(keep, bool) else keep).alias("keep"), F.lit(key).alias("key"), value.cast("double").alias("value"), flags.alias("flags"), unit.alias("unit"),
                        (F.lit(precision) if isinstance(precision, int) else precision).cast("int").alias("display_precision"))

    def told(rows: DataFrame, label: Column, cells: list[Column]) -> DataFrame:
        return rows.select("as_of", "metric_id", "cut", label.alias("label"), F.explode(F.filter(F.array(*cells), lambda f: f["keep"])).alias("f"))

    pct, count, score = (F.lit(x) for x in ("percent", "count", "score"))
    base, ratio = F.col("base"), F.col("statistic").isin("rate", "mean")
    adequacy, value = F.col("adequacy"), F.col("value")
    weekly = told(found.weeks, F.concat(F.lit(f"{COMPLETE}:"), F.date_add("week", 6).cast("string")), [
        fact("value", value, F.col("flags")), fact("n_obs", F.col("n_obs"), unit=count, precision=0), fact("wow_delta", F.col("wow_delta"), unit=points),
        fact("wow_pct", F.col("wow_pct"), unit=pct, precision=PCT_PRECISION), fact("baseline_mean", base["mean"], base["flags"]),
        fact("vs_baseline_pct", base["pct"], base["flags"], pct, PCT_PRECISION), fact("screening_z", base["z"], base["flags"], score, SCORE_PRECISION),
        fact("numerator", F.col("numerator"), adequacy, count, 0, ratio), fact("denominator", F.col("denominator"), adequacy, count, 0, ratio),
        fact("rate_z", F.col("rate_z"), adequacy, score, SCORE_PRECISION, F.col("statistic") == "rate"),
        fact("contribution_share_pct", F.col("share"), unit=pct, precision=PCT_PRECISION, keep=F.col("cut_dim").isNotNull() & ~ratio),
    ])
    robust = F.col("robust")
    daily = told(found.days, F.concat(F.lit(f"{DAILY}:"), F.col("day").cast("string")), [
        fact("value", value, F.col("flags")), fact("weekday_median", robust["median"], robust["flags"]), fact("robust_scale", robust["scale"], robust["flags"]),
        fact("robust_score", robust["score"], robust["flags"], score, SCORE_PRECISION),
    ])
    partly = told(found.running, F.concat(F.lit(f"{PARTIAL}:"), F.col("day").cast("string")), [
        fact("value", value, F.col("flags")), fact("slice_baseline_mean", base["mean"], base["flags"]), fact("vs_slice_pct", base["pct"], base["flags"], pct, PCT_PRECISION),
    ])
    rows = weekly.union(daily).union(partly).select("as_of", "metric_id", "cut", "label", "f.*")
    return rows.select("as_of", F.concat_ws("/", "metric_id", "cut", "label", "key").alias("id"), "value", "unit", "display_precision",
                       N.format_value(F.col("value"), F.col("unit"), F.col("display_precision")).alias("display"), "flags")


