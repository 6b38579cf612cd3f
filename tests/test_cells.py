"""Reading cells: what is refused, where it is, and what coverage and the grid make of gaps."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factweave.operators import records as R
from factweave.plans.calendar import build_plan
from factweave.plans.spec import SourceSpec, shop_registry
from factweave.sources import lines
from factweave.sources.cells import SourceError, first_offences, load_cells, read_cells_csv, source_summary, write_cells_csv

SPEC = SourceSpec(dims=("store", "device"))
HEAD = "date,store,device,sessions,orders,gmv"
FINE = "2031-03-14,Oslo 2,phone,40,3,71.5"
TODAY = date(2031, 3, 19)  # a Wednesday


def folder_of(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_rows_are_typed_and_stripped(spark, tmp_path):
    path = folder_of(tmp_path, a=f"{HEAD}\n{FINE}\n\n2031-03-15,  Bergen , tablet ,  7 ,0,.5\n")
    first, second = load_cells(spark, path, SPEC).orderBy("day").collect()
    assert (first.day, first.store, first.gmv) == (date(2031, 3, 14), "Oslo 2", 71.5)
    assert (second.store, second.device, second.sessions, second.gmv) == ("Bergen", "tablet", 7.0, 0.5)


BAD = {
    "no_rows": "", "date": "14.03.2031,Oslo,phone,4,3,2", "empty_label": "2031-03-14, ,phone,4,3,2", "reserved_label": "2031-03-14,__all,phone,4,3,2",
    "label_vocabulary": "2031-03-14,{{x}},phone,4,3,2", "not_numeric": "2031-03-14,Oslo,phone,four,3,2", "not_finite": "2031-03-14,Oslo,phone,4,+inf,2",
    "negative": "2031-03-14,Oslo,phone,4,3,-0.01", "field_count": "2031-03-14,Oslo,phone,4,3,2,1", "duplicate_cell": f"{FINE}\n2031-03-14,Oslo 2, phone,1,1,1",
}


@pytest.mark.parametrize("rule", sorted(BAD))
def test_each_rule_refuses(spark, tmp_path, rule):
    with pytest.raises(SourceError, match=rule) as e:
        load_cells(spark, folder_of(tmp_path, a=f"{HEAD}\n{BAD[rule]}\n"), SPEC)
    assert "{{x}}" not in str(e.value)


@pytest.mark.parametrize("day", ["2031-3-14", "2031-02-29", "20310314", "2031-03-14T00:00", ""])
def test_odd_days(spark, tmp_path, day):
    with pytest.raises(SourceError, match="date in date: 1 rows, first in a.csv line 2"):
        load_cells(spark, folder_of(tmp_path, a=f"{HEAD}\n{day},Oslo,phone,4,3,2\n"), SPEC)


def test_missing_and_wrong_columns(spark, tmp_path):
    with pytest.raises(SourceError, match="can't be read"):
        load_cells(spark, str(tmp_path / "nowhere"), SPEC)
    with pytest.raises(SourceError, match="a.csv: columns"):
        load_cells(spark, folder_of(tmp_path, a=f"date,store,sessions,orders,gmv\n{FINE}\n"), SPEC)


def test_files_with_other_orders_of_columns_are_named(spark, tmp_path):
    swapped = "date,device,store,orders,sessions,gmv\n2031-03-15,phone,Oslo,3,40,1\n"
    path = folder_of(tmp_path, a=f"{HEAD}\n{FINE}\n", b=swapped, c=f"{HEAD}\n2031-03-16,Oslo,phone,1,1,1\n", d=f"{FINE}\n")
    with pytest.raises(SourceError, match="b.csv, d.csv: columns must be date, store, device, sessions, orders, gmv, in this order, as in a.csv"):
        load_cells(spark, path, SPEC)


def test_quoted_headers_are_the_same_header(spark, tmp_path):
    quoted = ",".join(f'"{c}"' for c in HEAD.split(","))
    path = folder_of(tmp_path, a=f"{HEAD}\n{FINE}\n", b=f'{quoted}\n2031-03-15,"Oslo","phone",1,1,1\n', c=f"{HEAD}\r\n2031-03-16,Oslo,phone,1,1,1\r\n")
    assert load_cells(spark, path, SPEC).count() == 3


def test_first_offences_across_splits(spark, tmp_path):
    """Files of many splits: every rule's first file and line equals a plain reading of the files."""
    rng, want = random.Random(6), {}
    seen, files = set(), {}
    for name in ("m", "n", "z"):
        text = [HEAD]
        for i in range(1500):
            row = [(date(2001, 1, 1) + timedelta(rng.randrange(3000))).isoformat(), rng.choice(["Oslo", "Bergen", "Rome"]), rng.choice(["phone", "pad"]), "4", "3", "2"]
            broken = None
            if i > 400 and rng.random() < 0.01:
                broken, at, value = rng.choice([("date", 0, "x"), ("empty_label", 1, ""), ("negative", 4, "-1"), ("not_numeric", 3, "many"), ("not_finite", 5, "nan")])
                row[at] = value
            if rng.random() < 0.02:
                text.append(rng.choice(["", "   "]))
            text.append(",".join(row))
            places = [broken] if broken else []
            places += ["duplicate_cell"] if tuple(row[:3]) in seen else []
            seen.add(tuple(row[:3]))
            for rule in places:
                want.setdefault(rule, (f"{name}.csv", len(text)))
        if name == "n":
            text.append(HEAD)
        files[name] = "\n".join(text) + "\n"
    path = folder_of(tmp_path, **files)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows, pieces = read_cells_csv(spark, path, SPEC)
        assert pieces.count() > 10 and rows.where("NOT _head").select("_file").distinct().count() == 3
        got = {r["rule"]: (r["file"].rsplit("/", 1)[-1], r["line"]) for r in first_offences(rows, pieces, SPEC).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got.pop("repeated_header") == ("n.csv", files["n"].count("\n"))
    assert got == want


def test_a_repeated_header_is_refused(spark, tmp_path):
    with pytest.raises(SourceError, match="repeated_header in .: 1 rows, first in b.csv line 4"):
        load_cells(spark, folder_of(tmp_path, a=f"{HEAD}\n{FINE}\n", b=f"{HEAD}\n2031-03-15,Oslo,phone,1,1,1\n\n{HEAD}\n"), SPEC)


def test_line_numbers_of_plain_lines(spark, tmp_path):
    path = folder_of(tmp_path, a="x\n" * 3, b="y\n\nz\n")
    read = lines.read_lines(spark, path)
    found = read.select("value", lines.place().alias("at"))
    got = sorted((r.file[-5:], r.line, r.value) for r in lines.located(found, lines.splits(read)).collect())
    assert got == [("a.csv", 1, "x"), ("a.csv", 2, "x"), ("a.csv", 3, "x"), ("b.csv", 1, "y"), ("b.csv", 2, ""), ("b.csv", 3, "z")]


def daily(spark, start, days, store="Oslo"):
    rows = [(start + timedelta(i), store, "phone", 200.0, 8.0, 300.0) for i in range(days)]
    return spark.createDataFrame(rows, "day date, store string, device string, sessions double, orders double, gmv double")


@pytest.mark.parametrize("start,end,status", [(-100, -1, "ok"), (-100, -9, "stale"), (-30, -1, "incomplete"), (-100, -2, "incomplete")])
def test_coverage(spark, start, end, status):
    rows = R.coverage(daily(spark, TODAY + timedelta(start), end - start + 1), shop_registry(*SPEC.dims), build_plan(TODAY)).collect()
    assert {r.status for r in rows} == {status}
    if end == -2:
        assert "2031-03-18" in rows[0].detail


def test_grid_fills_a_segment_that_stopped(spark):
    plan = build_plan(TODAY)
    cells = daily(spark, TODAY - timedelta(100), 100).union(daily(spark, plan.week.start - timedelta(7), 7, "Rome"))
    rows = R.records(cells, shop_registry("store"), SPEC, plan).where(F.col("period_label") == plan.week.label).collect()
    by = {(r.metric_id, r.cut): r for r in rows}
    gone, rate = by["gmv", "store=Rome"], by["conversion_rate", "store=Rome"]
    assert gone.value == 0 and gone.provenance == "zero_fill" and gone.flags == ["zero_filled"]
    assert rate.value is None and rate.flags == ["no_exposure", "zero_filled"] and rate.denominator == 0
    assert by["conversion_rate", "overall"].value == pytest.approx(4.0) and by["aov", "overall"].value == 37.5
    assert ("gmv", "device=phone") not in by


def test_round_trip_csv(spark, tmp_path):
    cells = daily(spark, TODAY, 4)
    write_cells_csv(cells, str(tmp_path / "out"), SPEC)
    again = load_cells(spark, str(tmp_path / "out"), SPEC)
    assert sorted(again.collect()) == sorted(cells.collect())
    assert source_summary(again).first().n_rows == 4
