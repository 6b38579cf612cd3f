"""Daily cells from an event stream: watermark, one-day windows, append when a day is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_cells(events: DataFrame, *, lateness: str = "1 day") -> DataFrame:
    """Cells of factweave.sources.cells.cells_from_events; a day leaves once it is ``lateness`` behind the newest event."""
    bought = F.col("event_type") == "purchase"
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(
        F.window("ts", "1 day").alias("w"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("bucket"),
        F.concat(F.lit("h"), F.floor(F.hour("ts") / 6).cast("string")).alias("part"),
    ).agg(
        F.count("*").cast("double").alias("sessions"), F.count_if(bought).cast("double").alias("orders"),
        F.coalesce(F.sum(F.when(bought, F.col("value").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("gmv"),
    ).select(F.to_date("w.start").alias("day"), "bucket", "part", "sessions", "orders", "gmv")


def write_cells(cells: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return cells.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(table)
