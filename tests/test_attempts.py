"""Rounds over many drafts: what is asked again, what is kept, and how drafts end."""

from pyspark.sql import functions as F

from factweave.operators import attempts as A

SCRIPT = [("never", 0, "bad"), ("once", 0, "good"), ("second", 0, "bad"), ("second", 1, "good"), ("third", 0, "bad"), ("third", 2, "good"), ("stuck", 0, "bad bad")]


def test_rounds(spark):
    drafts = spark.createDataFrame([(d,) for d in ("once", "second", "third", "stuck", "never", "silent", "once", None)], "draft_id string")
    script = spark.createDataFrame(SCRIPT, "draft_id string, attempt int, text string")
    checked = []

    def check(replies):
        checked.append(sorted(r["draft_id"] for r in replies.collect()))
        words = replies.select("draft_id", F.explode(F.split("text", " ")).alias("code"))
        return words.where("code = 'bad'")

    got = {(r["draft_id"], r["attempt"]): (r["state"], r["n_violations"], r["text"]) for r in A.draft_until_valid(drafts, A.scripted(script), check).collect()}
    assert got == {
        ("once", 0): ("passed", 0, "good"), ("second", 0): ("open", 1, "bad"), ("second", 1): ("passed", 0, "good"),
        ("third", 0): ("open", 1, "bad"), ("third", 1): ("open", 1, "bad"), ("third", 2): ("passed", 0, "good"),
        ("stuck", 0): ("open", 2, "bad bad"), ("stuck", 1): ("open", 2, "bad bad"), ("stuck", 2): ("refused", 2, "bad bad"),
        ("never", 0): ("open", 1, "bad"), ("never", 1): ("open", 1, "bad"), ("never", 2): ("refused", 1, "bad"), ("silent", 0): ("no-reply", 0, None),
    }
    assert checked == [["never", "once", "second", "stuck", "third"], ["never", "second", "stuck", "third"], ["never", "stuck", "third"]]


def test_no_drafts_and_no_retries(spark):
    script = spark.createDataFrame(SCRIPT, "draft_id string, attempt int, text string")
    check = lambda replies: replies.select("draft_id", F.lit("E").alias("code"))
    assert A.draft_until_valid(spark.createDataFrame([], "draft_id string"), A.scripted(script), check).collect() == []
    one = A.draft_until_valid(spark.createDataFrame([("once",)], "draft_id string"), A.scripted(script), check, max_retries=0).collect()
    assert [(r["attempt"], r["state"], r["codes"]) for r in one] == [(0, "refused", ["E"])]
