"""Events in any order against the whole table at once, and batches that are run again."""

import random
from datetime import datetime, timedelta

import pytest

from factweave.sources.cells import cells_from_events
from factweave.streaming import late as LT

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(n=600, seed=2):
    rng = random.Random(seed)
    start = datetime(2031, 5, 1)
    return [(i, start + timedelta(minutes=rng.randrange(30 * 1440)), rng.randrange(9), rng.choice(["purchase", "view"]), rng.choice([None, 0.1, 2.35, 7.0]), "p") for i in range(n)]


def cells(df):
    return sorted((r["day"], r["bucket"], r["part"], r["sessions"], r["orders"], round(r["gmv"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(events(), SCHEMA).persist()


def test_a_shuffled_replay_equals_the_table(spark, table, tmp_path):
    table.repartition(6, "event_id").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        LT.fold_events(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert cells(LT.current_cells(spark, str(tmp_path / "out"))) == cells(cells_from_events(table))
    more = spark.createDataFrame([(9999, datetime(2020, 1, 1), 1, "purchase", 5.0, "p")], SCHEMA)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    LT.fold_events(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert cells(LT.current_cells(spark, str(tmp_path / "out"))) == cells(cells_from_events(table.union(more)))


def test_late_rows_are_counted_and_only_changed_weeks_computed(spark, table, tmp_path):
    folder, rows = str(tmp_path), events()
    batches = [[r for r in rows if r[1].day <= 10], [r for r in rows if r[1].day > 20], [r for r in rows if 10 < r[1].day <= 20]]
    for i, batch in enumerate(batches):
        for _ in range(2):  # a batch that is run again replaces itself
            LT.add_batch(spark.createDataFrame(batch, SCHEMA), i, folder)
    got = LT.current_cells(spark, folder)
    assert cells(got) == cells(cells_from_events(table))
    newest = max(r[1] for r in rows).date()
    assert sum(r["late"] for r in got.collect()) == sum(r[1].date() < newest - timedelta(1) for r in batches[2])
    week = lambda t: t.date() - timedelta((t.weekday() + 1) % 7)
    last = {}
    for i, batch in enumerate(batches):
        last.update({week(r[1]): i for r in batch})
    weeks = LT.current_weeks(spark, folder).collect()
    assert {r["week"]: r["batch"] for r in weeks} == last
    want = {}
    for r in rows:
        key = (week(r[1]), f"u{r[2] % 4}")
        want[key] = want.get(key, 0) + 1
    assert {(r["week"], r["bucket"]): r["sessions"] for r in weeks} == want


def test_empty_batches(spark, tmp_path):
    LT.add_batch(spark.createDataFrame([], SCHEMA), 0, str(tmp_path))
    LT.add_batch(spark.createDataFrame(events(5), SCHEMA), 1, str(tmp_path))
    assert sum(r["sessions"] for r in LT.current_cells(spark, str(tmp_path)).collect()) == 5
