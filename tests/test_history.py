"""Reports of many dates against reports of one date."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factweave.operators import facts as FA, history as H, records as R
from factweave.plans.calendar import build_plan
from factweave.plans.spec import SourceSpec, shop_registry

SPEC = SourceSpec(dims=("store", "device"))
REGISTRY = shop_registry(*SPEC.dims)
START, DAYS = date(2030, 1, 3), 150


@pytest.fixture(scope="module")
def cells(spark):
    """Series with gaps, one that comes late, one that ends, one of a single day, and days without any row."""
    rows = []
    for i in range(DAYS):
        day = START + timedelta(i)
        for store, seen in (("Oslo", True), ("Rome", i % 3 == 0), ("Late", i > 90), ("Early", i < 25), ("Once", i == 40), ("Zero", i % 2 == 0)):
            for device in ("phone", "pad"):
                if seen and i not in (60, 61) and (i * 7 + len(store)) % 11:
                    n = 0.0 if store == "Zero" else float((i * 37 + len(store) * 5 + len(device)) % 90)
                    rows.append((day, store, device, n, float(int(n) // 9), n * 2.25))
    return spark.createDataFrame(rows, "day date, store string, device string, sessions double, orders double, gmv double").persist()


def own_facts(cells, as_of):
    """The facts of one report about its own periods."""
    plan = build_plan(as_of)
    facts = FA.facts(FA.compared(R.records(cells, REGISTRY, SPEC, plan), REGISTRY, plan), plan)
    labels = {plan.week.label, *(d.label for d in plan.days)} | ({plan.running.label} if plan.running else set())
    rows = facts.where(F.col("period_label").isin(*labels)).select("id", "value", "unit", "display_precision", "display", "flags").collect()
    return {r["id"]: (None if r["value"] is None else round(r["value"], 8), *r[2:5], r["flags"]) for r in rows}


def test_every_date_equals_its_own_report(spark, cells):
    stretch = H.Stretch(START + timedelta(10), START + timedelta(DAYS + 20))
    got = {}
    for r in H.history_facts(H.history(cells, REGISTRY, SPEC, stretch), REGISTRY).collect():
        known = got.setdefault(r["as_of"], {})
        assert r["id"] not in known
        known[r["id"]] = (None if r["value"] is None else round(r["value"], 8), *r[3:6], r["flags"])
    assert sorted(got)[0] == stretch.first and all(stretch.first <= d <= stretch.last for d in got)
    for back in (0, 3, 4, 24, 45, 93, 130, 160):
        as_of = stretch.first + timedelta(back)
        want = own_facts(cells, as_of)
        if as_of.weekday() == 6:
            assert got.get(as_of, {}) == want
        else:  # the week under review is that of the Sunday before
            assert got.get(as_of, {}) == {k: v for k, v in want.items() if "/partial_week:" in k}


def test_no_cells(spark, cells):
    found = H.history(cells.where("false"), REGISTRY, SPEC, H.Stretch(START, START + timedelta(30)))
    assert H.history_facts(found, REGISTRY).collect() == []
