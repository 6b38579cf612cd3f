from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factweave.functions import dates as D
from factweave.plans import calendar as cal
from factweave.plans.spec import RegistryError, SourceSpec, load_registry, parse_registry, shop_registry


def test_weeks_open_on_sunday():
    for day in range(2, 9):  # Sunday to Saturday are days of one week
        assert cal.number(date(2026, 8, day)) // 7 == cal.number(date(2026, 8, 2)) // 7
    week = cal.build_plan(date(2026, 8, 13)).week
    assert (week.start, week.end, week.days) == (date(2026, 8, 2), date(2026, 8, 8), 7)


@pytest.mark.parametrize("as_of,week_end,running", [
    (date(2026, 8, 13), date(2026, 8, 8), (date(2026, 8, 9), date(2026, 8, 12))),
    (date(2026, 8, 9), date(2026, 8, 8), None),
    (date(2026, 8, 10), date(2026, 8, 8), (date(2026, 8, 9), date(2026, 8, 9))),
])
def test_plan(as_of, week_end, running):
    plan = cal.build_plan(as_of)
    assert plan.week.end == week_end
    assert (plan.running and (plan.running.start, plan.running.end)) == running
    assert len(plan.spans()) == (73 if running else 68)


def test_plan_spans_its_days():
    plan = cal.build_plan(date(2026, 8, 13))
    assert plan.reach == (date(2026, 6, 7), date(2026, 8, 12)) and len(plan.numbers()) == 67
    assert [s.phrase for s in (plan.week, plan.days[0], plan.running)] == ["week ending 2026-08-08", "day 2026-08-02", "partial week 2026-08-09..2026-08-12"]
    with pytest.raises(ValueError):
        cal.build_plan(date(2026, 1, 2), -1)


def test_columns_agree_with_plan(spark):
    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(60)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d", D.week_start(F.col("d")).alias("s"), D.review_week_start(F.col("d")).alias("r"), D.partial_week_start(F.col("d")).alias("p"),
        D.prior_week_starts(D.week_start(F.col("d")), 2).alias("b")).collect()
    for r in rows:
        plan = cal.build_plan(r.d)
        assert cal.number(r.s) == cal.number(r.d) // 7 * 7 and r.r == plan.week.start and r.p == (plan.running.start if plan.running else None)
        assert r.b == [r.s - timedelta(days=7), r.s - timedelta(days=14)]


GOOD = {"id": "m", "title": "M", "metric_type": "rate", "statistic": "rate", "numerator_field": "orders", "denominator_field": "sessions", "unit": "percent", "display_precision": 2, "cuts": ["a"]}


@pytest.mark.parametrize("change", [
    {"metric_type": "x"}, {"statistic": "mean"}, {"denominator_field": None}, {"unit": "eur"}, {"display_precision": -1}, {"cuts": ["a", "a"]}, {"color": "red"}, {"title": ""},
])
def test_registry_refuses(change):
    with pytest.raises(RegistryError):
        parse_registry({"schema_version": 2, "metric": [{**GOOD, **change}]})


def test_registry():
    assert parse_registry({"schema_version": 2, "metric": [GOOD]}).by_id["m"].tolerance == 0.005
    for raw in ({"schema_version": 1, "metric": [GOOD]}, {"schema_version": 2}, {"schema_version": 2, "metric": [GOOD, GOOD]}):
        with pytest.raises(RegistryError):
            parse_registry(raw)
    with pytest.raises(RegistryError):
        shop_registry("nowhere").check(SourceSpec(dims=("country",)))


def test_example_registry(tmp_path):
    from pathlib import Path

    found = load_registry(Path(__file__).parent.parent / "examples" / "shop.toml")
    assert found.metrics == shop_registry("country", "channel").metrics and len(found.sha256) == 64
    (tmp_path / "bad.toml").write_text("schema_version = ")
    for path in (tmp_path / "bad.toml", tmp_path / "none.toml"):
        with pytest.raises(RegistryError):
            load_registry(path)
