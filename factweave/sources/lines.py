"""Text files as numbered lines: which file and which line a row comes from, across splits, and how the files' headers agree.

A row carries its file, the offset at which its split starts, and a number that
grows within a task.  One row per split (its number of lines and its least
number) turns that into a line of the file: lines of the splits before it, plus
the place within its own.  Nothing but those rows, and the rows that are asked
about, is ever looked at twice; no file is read as a whole by one task.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where a line is: fields of this order compare as files and lines do.
PLACE = ("_file", "_block", "_at")
#: So many spellings of one header are refused.
MOST_HEADERS = 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and the columns of PLACE; files below ``path``, however deep."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def place() -> Column:
    return F.struct(*PLACE)


def splits(lines: DataFrame) -> DataFrame:
    """One row per split: _file, _block, first (its least number), before (lines of the file's earlier splits), head (its first line)."""
    each = lines.groupBy("_file", "_block").agg(F.min("_at").alias("first"), F.count("*").alias("lines"), F.min_by("value", "_at").alias("head"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_file", "_block", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"), "head", "lines")


def located(found: DataFrame, pieces: DataFrame, at: str = "at") -> DataFrame:
    """``found`` with file and line in place of its column ``at`` (a place, or null)."""
    own = found.select("*", F.col(f"{at}._file").alias("_file"), F.col(f"{at}._block").alias("_block"))
    joined = own.join(pieces.select("_file", "_block", "first", "before"), ["_file", "_block"], "left")
    line = F.col("before") + F.col(f"{at}._at") - F.col("first") + 1
    return joined.select(*[c for c in found.columns if c != at], F.col("_file").alias("file"), line.alias("line"))


def header_names(line: str | None) -> tuple[str, ...]:
    """The column names of a header line, quoted or not."""
    fields = next(csv.reader([(line or "").removeprefix("\ufeff")]), [])
    return tuple(f.strip() for f in fields)


def headers(pieces: DataFrame) -> list[tuple[str, str]]:
    """The distinct first lines of files, each with the first file that has it; of MOST_HEADERS different ones no more are looked at."""
    tops = pieces.where("_block = 0").groupBy("head").agg(F.min("_file").alias("file"))
    return [(r["file"], r["head"]) for r in tops.orderBy("file").limit(MOST_HEADERS).collect()]
