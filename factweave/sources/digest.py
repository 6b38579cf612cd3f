"""SHA-256 of the bytes of text files, computed by tasks that never hold a file.

A file is read as lines whose bytes stay as they are (only ``\\n`` parts lines).
Each line's offset is the sum of the lines before it: of the file's earlier
splits, and of its own.  Lines then go to the piece in which they start, in
order, and a task streams the bytes of a piece through one hash.  With
``piece_bytes`` a file is a tree: pieces, nodes of FAN pieces, and the file, so
no task meets more than a piece, and how Spark splits files doesn't matter.
Without it a file is one piece, and its digest the plain SHA-256, which only a
single task can go through (its memory is bounded, too).

A byte order mark at a file's start and a missing last line end, which a line
reader drops, follow from the file's length.  Compressed files are digested as
the text they hold, a last line end added.  Files of no bytes have no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE_BYTES = 64 << 20
FAN = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def byte_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (offset of a line) and bytes (its own, line end and mark included)."""
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    lines = raw.select(F.col("value").cast("binary").alias("bytes"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
                       meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("at"))
    length = (F.octet_length("bytes") + 1).cast("long")
    per_split = lines.groupBy("file", "block").agg(F.sum(length).alias("own"), F.max("size").alias("size"))
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = per_split.select("file", "block", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"), F.sum("own").over(whole).alias("total"), "size")
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.drop("size").withColumn("inside", F.coalesce(F.sum(length).over(within), F.lit(0))).join(splits, ["file", "block"])
    start, spare = F.col("before") + F.col("inside"), F.col("size") - F.col("total")
    mark = F.when((start == 0) & spare.isin(2, 3), F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b""))
    end = F.when((start + length == F.col("total")) & spare.isin(-1, 2), F.lit(b"")).otherwise(F.lit(b"\n"))
    return placed.select("file", start.alias("start"), F.concat(mark, "bytes", end).alias("bytes"))


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal (file, piece); rows come sorted."""
    key, running, size = None, None, 0
    row = lambda: pa.RecordBatch.from_pydict({"file": [key[0]], "piece": pa.array([key[1]], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "sha256": [running.hexdigest()]})
    for batch in batches:
        for file, piece, part in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), batch.column("bytes")):
            if (file, piece) != key:
                if key is not None:
                    yield row()
                key, running, size = (file, piece), hashlib.sha256(), 0
            data = part.as_buffer()
            running.update(data)
            size += len(data)
    if key is not None:
        yield row()


def piece_digests(spark: SparkSession, path: str, piece_bytes: int | None) -> DataFrame:
    """file, piece, n_bytes, sha256 of the lines that start in each range of ``piece_bytes``; null: of the whole file."""
    piece = F.lit(0).cast("long") if piece_bytes is None else F.floor(F.col("start") / piece_bytes)
    lines = byte_lines(spark, path).withColumn("piece", piece)
    sorted_ = lines.repartition("file", "piece").sortWithinPartitions("file", "piece", "start").select("file", "piece", "bytes")
    return sorted_.mapInArrow(_digest_runs, "file string, piece long, n_bytes long, sha256 string")


def _joined(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Parts of the same keys as one: the digest of their digests in hex, one after the other by ``order``."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("place"), F.col("sha256").alias("digest"))))
    return parts.groupBy(*keys).agg(F.sum("n_bytes").alias("n_bytes"), F.sha2(F.array_join(listed["digest"], ""), 256).alias("sha256"))


def file_digests(spark: SparkSession, path: str, piece_bytes: int | None = None) -> DataFrame:
    """file, n_bytes, sha256 of each file below ``path``: plain, or with ``piece_bytes`` a tree's."""
    pieces = piece_digests(spark, path, piece_bytes)
    if piece_bytes is None:
        return pieces.drop("piece")
    nodes = _joined(pieces.withColumn("node", F.floor(F.col("piece") / FAN)), ["file", "node"], "piece")
    return _joined(nodes, ["file"], "node")


def source_digest(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> str:
    """The plain SHA-256 of a single file; of a folder a tree over the digests of its files, each a tree itself, whatever their names.

    Files are first joined by the first three hex digits of their digests.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        row = file_digests(spark, path).first()
    else:
        files = file_digests(spark, path, piece_bytes).select(F.substring("sha256", 1, 3).alias("bin"), F.lit(0).alias("all"), "n_bytes", "sha256")
        row = _joined(_joined(files, ["all", "bin"], "sha256"), ["all"], "bin").first()
    return row["sha256"] if row else EMPTY
