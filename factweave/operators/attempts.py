"""Drafting until valid for any number of drafts: rounds over the drafts that are still open.

Each round asks for replies to the open drafts only, checks those, keeps every
reply as a version, and leaves open what failed.  Rounds are bounded by the
retries; what a round reads is the table of the one before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.tables import written

PASSED, OPEN, REFUSED, SILENT = "passed", "open", "refused", "no-reply"
SHAPE = "draft_id string, attempt int, text string, n_violations long, codes array<string>, state string"

#: From (draft_id, attempt, codes of the attempt before) to (draft_id, text); drafts may be missing.
Reply = Callable[[DataFrame], DataFrame]
#: From (draft_id, text) to rows with draft_id and code, one per violation.
Check = Callable[[DataFrame], DataFrame]


def scripted(script: DataFrame) -> Reply:
    """Replies given beforehand as (draft_id, attempt, text); where an attempt has none, the latest earlier one is said again."""

    def reply(asked: DataFrame) -> DataFrame:
        said = script.select(F.col("draft_id").alias("s_id"), F.col("attempt").alias("s_attempt"), "text")
        fits = (F.col("draft_id") == F.col("s_id")) & (F.col("s_attempt") <= F.col("attempt"))
        return asked.join(said, fits).groupBy("draft_id").agg(F.max_by("text", "s_attempt").alias("text"))

    return reply


def draft_until_valid(drafts: DataFrame, reply: Reply, check: Check, max_retries: int = 2) -> DataFrame:
    """Every attempt of every draft (draft_id): attempt (from 0), text, n_violations, codes, state.

    state is ``passed``, ``open`` (failed, tried again), ``refused`` (failed, no
    retry left), or ``no-reply`` (nothing was said, so nothing more is asked).
    Rows of one draft_id are one draft; a null draft_id is none.
    """
    asked = drafts.where("draft_id IS NOT NULL").select("draft_id").distinct().select("draft_id", F.lit(0).alias("attempt"), F.array().cast("array<string>").alias("codes"))
    versions = []
    for attempt in range(max_retries + 1):
        asked = written(asked, "asked")
        if asked.isEmpty():
            break
        replies = written(reply(asked).select("draft_id", "text"), "replies")
        found = check(replies).groupBy("draft_id").agg(F.count("*").alias("n_violations"), F.array_sort(F.collect_set("code")).alias("found"))
        state = F.when(F.col("r_id").isNull(), SILENT).when(F.col("n_violations").isNull(), PASSED).otherwise(OPEN if attempt < max_retries else REFUSED)
        tried = asked.select("draft_id", "attempt").join(replies.select(F.col("draft_id").alias("r_id"), "text"), F.col("draft_id") == F.col("r_id"), "left").join(found, "draft_id", "left")
        tried = written(tried.select(
            "draft_id", "attempt", "text", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.coalesce("found", F.array().cast("array<string>")).alias("codes"), state.alias("state")), "attempts")
        versions.append(tried)
        asked = tried.where(F.col("state") == OPEN).select("draft_id", (F.col("attempt") + 1).alias("attempt"), "codes")
    if not versions:
        return drafts.sparkSession.createDataFrame([], SHAPE)
    out = versions[0]
    for v in versions[1:]:
        out = out.unionByName(v)
    return out
