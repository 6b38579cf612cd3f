"""Choice of stories against a plain fold, and the rules that the given data never meet."""

import random
from datetime import date, timedelta

from factweave.operators import stories as ST

SCHEMA = ("report int, rank int, metric_id string, cut string, channels array<string>, value double, wow_pct double, z double, flags array<string>, day date, score double")


def plain(rows):
    """One report: rank -> (kind, severity, outcome, place)."""
    out, queue = {}, []
    for _, rank, metric, cut, channels, value, pct, z, flags, day, score in rows:
        size, move = abs(z or 0), abs(pct or 0)
        if "disappeared" in channels and value is not None:
            kind, weight, level = "disappeared", 1000, "high"
        elif "newly_appeared" in channels and value is not None:
            kind, weight, level = "newly_appeared", 900, "medium"
        elif score is not None and abs(score) >= 6:
            kind, weight, level = "daily", abs(score), "high"
        elif move >= 3 and (size >= 2.5 or move >= 8):
            kind, weight = "weekly", 20 + max(size, move / 2)
            level = "high" if move >= 20 or size >= 3 else "medium" if move >= 8 or size >= 2 else "low"
        else:
            thin, doubtful = {"no_baseline", "thin_baseline"} & set(flags), {"small_cell", "small_denominator", "no_exposure"} & set(flags)
            small = "within-baseline-variation" if pct is not None and move < 8 else "small-absolute-impact"
            out[rank] = (None, None, "insufficient-baseline" if thin else "data-quality" if doubtful else small, None)
            continue
        queue.append((-round(weight, 6), rank, kind, level, metric, cut, day if kind == "daily" else None))
    told = []
    for _, rank, kind, level, metric, cut, day in sorted(queue, key=lambda q: q[:2]):
        crowded = sum(t[0] == metric for t in told) >= 3 or any(t[1] == cut for t in told) or (day and any(t[2] == day for t in told))
        outcome = "duplicate-of-highlight" if crowded else "small-absolute-impact" if len(told) >= 6 else "told"
        out[rank] = (kind, level, outcome, len(told) if outcome == "told" else None)
        if outcome == "told":
            told.append((metric, cut, day))
    return out


def reports(seed=4, n=60):
    rng, rows = random.Random(seed), []
    for report in range(n):
        for rank in range(1, rng.randint(2, 40)):
            channel = rng.choices([["overall"], ["disappeared"], ["newly_appeared", "screening_z"], ["screening_z"]], [4, 1, 1, 6])[0]
            rows.append((report, rank, rng.choice("abcd"), rng.choice("pqrstuvwxyz"), channel, rng.choice([None, 1.0, 5.0, 7.0]), rng.choice([None, 1.0, -4.0, 9.0, -25.0, 3.0, 8.0, rng.uniform(-30, 30)]),
                         rng.choice([None, 0.5, -2.5, 3.0, 2.0]), rng.choice([[], ["thin_baseline"], ["no_exposure"], ["zero_filled"]]),
                         date(2030, 1, 6) + timedelta(rng.randrange(4)), rng.choice([None, None, 5.9, -6.0, 8.25])))
    return rows


def test_choice_equals_a_plain_fold_in_any_order(spark):
    rows = reports()
    want = {(r, k): v for r in {x[0] for x in rows} for k, v in plain([x for x in rows if x[0] == r]).items()}
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    for given in (rows, shuffled):
        got = ST.select_stories(spark.createDataFrame(given, SCHEMA), ("report",)).collect()
        assert {(r["report"], r["rank"]): (r["kind"], r["severity"], r["outcome"], r["place"]) for r in got} == want and len(got) == len(rows)
    outcomes = {v[2] for v in want.values()}
    assert outcomes == {"told", "duplicate-of-highlight", "small-absolute-impact", "insufficient-baseline", "data-quality", "within-baseline-variation"}


def test_one_report_without_a_key_and_none(spark):
    rows = [r for r in reports() if r[0] == 3]
    got = ST.select_stories(spark.createDataFrame(rows, SCHEMA).drop("report")).collect()
    assert {r["rank"]: (r["kind"], r["severity"], r["outcome"], r["place"]) for r in got} == plain(rows)
    assert ST.select_stories(spark.createDataFrame([], SCHEMA), ("report",)).collect() == []
