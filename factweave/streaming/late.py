"""Daily cells from a stream whose rows come in any order, however late.

Each batch adds what it holds to a log of sums per day and segment, under its
own number, so a batch that is run again after a failure replaces itself.
Cells are the log added up: no day ever closes and no row is dropped.  Rows
older than the newest day of earlier batches by more than ``slack_days`` are
counted as late.  Weekly totals are kept as versions: a batch computes again
only the weeks of which it holds a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.functions.dates import week_start
from factweave.sources.cells import event_sums

KEYS, SUMS = ("day", "bucket", "part"), ("sessions", "orders", "gmv")


def _log(spark: SparkSession, folder: str, name: str, upto: int | None = None) -> DataFrame:
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows if upto is None else rows.where(F.col("batch") <= upto)


def add_batch(events: DataFrame, batch: int, folder: str, slack_days: int = 1) -> None:
    """Put one batch into the log and compute its weeks again."""
    spark = events.sparkSession
    newest = None
    if batch and (seen := _log(spark, folder, "sums", batch - 1).agg(F.max("day")).first()):
        newest = seen[0]
    late = F.coalesce(F.col("day") < F.date_sub(F.lit(newest).cast("date"), slack_days), F.lit(False))
    sums = event_sums(events).withColumn("late", F.when(late, F.col("sessions")).otherwise(F.lit(0).cast("long")))
    sums.write.mode("overwrite").parquet(f"{folder}/sums/batch={batch}")
    week = week_start(F.col("day")).alias("week")
    log = _log(spark, folder, "sums", batch)
    changed = log.where(F.col("batch") == batch).select(week).distinct()
    weeks = log.select(week, "bucket", *SUMS).join(changed, "week", "left_semi").groupBy("week", "bucket").agg(*[F.sum(m).alias(m) for m in SUMS])
    weeks.write.mode("overwrite").parquet(f"{folder}/weeks/batch={batch}")


def fold_events(events: DataFrame, folder: str, checkpoint: str, slack_days: int = 1) -> StreamingQuery:
    """Start the stream; it ends when all that is there has been read."""
    writer = events.writeStream.foreachBatch(lambda rows, batch: add_batch(rows, batch, folder, slack_days))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells so far, with ``late``: how many rows of a cell came late."""
    return _log(spark, folder, "sums").groupBy(*KEYS).agg(*[F.sum(m).cast("double").alias(m) for m in SUMS], F.sum("late").alias("late"))


def current_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of each week's totals per bucket, and the batch it is of."""
    log = _log(spark, folder, "weeks")
    last = log.groupBy(F.col("week").alias("l_week")).agg(F.max("batch").alias("l_batch"))
    rows = log.join(last, (F.col("week") == F.col("l_week")) & (F.col("batch") == F.col("l_batch")))
    return rows.select("week", "bucket", *[F.col(m).cast("double").alias(m) for m in SUMS], F.col("batch").cast("long").alias("batch"))
