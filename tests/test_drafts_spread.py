"""Reading drafts is work: it is spread whatever the split of the file, and done once."""

import json

from pyspark.sql import functions as F

from factweave.operators import binding, render


def one_split(spark, n: int = 40):
    head = lambda i: {"title": f"- <{i}>", "metric_id": "gmv", "cut": "a|b", "severity": ("low", "high", "medium")[i % 3], "narrative": " n\n", "claims": []}
    rows = [(str(i), json.dumps({"highlights": [head(i), head(i + 1)], "dismissals": [{}]})) for i in range(n)] + [("bad", "{"), ("none", None)]
    return spark.createDataFrame(rows, "draft_id string, text string").coalesce(1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_highlights_are_read_by_all_tasks(spark):
    drafts = one_split(spark)
    found = binding.highlights(drafts)
    assert drafts.rdd.getNumPartitions() == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_rendered_as_before(spark):
    rows = render.rendered(one_split(spark)).collect()
    assert len(rows) == 80
    for r in rows:
        i = int(r.draft_id) + r.highlight
        assert (r.title, r.cut, r.narrative, r.hypothesis, r.redactions) == (f"\\- {i}", "a\\|b", "n", "", 3)
        assert r.severity == ("low", "high", "medium")[i % 3]
    assert {(r.draft_id, r.place) for r in rows} == {(str(i), p) for i in range(40) for p in (1, 2)}


def test_drafts_are_parsed_before_they_are_read(spark):
    """The three kinds of rows read what was parsed; none parses again, and every task has some."""
    read = binding.read_drafts(one_split(spark))
    assert plan(read).count("FileScan parquet") == 3 and "Exchange" not in plan(read)
    found = read.select("draft_id", "highlight", F.explode("findings").alias("f")).groupBy("f.code").count().collect()
    assert {r["code"]: r["count"] for r in found} == {"E001": 42, "E040": 80}
    assert read.where("highlight IS NOT NULL").count() == 80
