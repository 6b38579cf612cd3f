"""A seeded shop of daily cells with growth, a weekly season and planted events, made by Spark."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans.spec import SourceSpec

SHOP = SourceSpec(dims=("country", "channel"))
COUNTRIES = {"US": 1.0, "DE": 0.6, "FR": 0.45, "GB": 0.5, "JP": 0.3}
CHANNELS = {"organic": 1.0, "paid": 0.8, "email": 0.35, "social": 0.4, "direct": 0.7, "referral": 0.2}


def generate_cells(spark: SparkSession, start: date, end: date, *, seed: int = 7, events: bool = True) -> DataFrame:
    """One row per day, country and channel; with ``events``, a spike, a drop, a stop and an arrival near the end."""
    days = spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"), F.col("id").alias("age"))
    table = lambda name, sizes: spark.createDataFrame(list(sizes.items()), f"{name} string, {name}_size double")
    channels = CHANNELS | ({"affiliate": 0.25} if events else {})
    grid = days.crossJoin(F.broadcast(table("country", COUNTRIES))).crossJoin(F.broadcast(table("channel", channels)))

    def noise(what: str):
        """Uniform in (-1, 1), the same for a cell whatever the partitioning."""
        h = F.xxhash64(F.lit(seed), F.lit(what), "day", "country", "channel")
        return F.pmod(h, F.lit(2_000_001)) / 1_000_000.0 - 1

    weekend = F.when(F.dayofweek("day").isin(1, 7), 0.85).otherwise(1.0)
    left = F.datediff(F.lit(end), F.col("day"))
    sessions = 2000 * F.col("country_size") * F.col("channel_size") * weekend * F.pow(F.lit(1.0004), F.col("age")) * (1 + 0.08 * noise("s"))
    rate = 0.03 * (1 + 0.1 * noise("o"))
    if events:
        sessions = sessions * F.when((left == 6) & (F.col("country") == "DE") & (F.col("channel") == "paid"), 4.0).otherwise(1.0)
        rate = rate * F.when(left.between(4, 10) & (F.col("country") == "FR"), 0.6).otherwise(1.0)
    out = grid.withColumn("sessions", F.round(sessions)).withColumn("orders", F.round(F.col("sessions") * rate))
    out = out.withColumn("gmv", F.round(F.col("orders") * 80 * (1 + 0.05 * noise("g")), 2))
    if events:
        out = out.where(~((left <= 10) & (F.col("channel") == "referral") & (F.col("country") == "JP")))
        out = out.where((F.col("channel") != "affiliate") | (left <= 9))
    return out.where("sessions > 0").select("day", "country", "channel", "sessions", "orders", "gmv")
