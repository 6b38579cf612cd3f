r"""Importance resampling towards a target distribution, over hashed n-grams of words.

One scan of a document keeps a ring with the running zlib state of its last
``n`` starts.  A word begins one start and extends each of the others by a
space and itself, and every state that this gives is a feature's crc32, whose
bucket is the crc32 modulo ``buckets``.  The scan leaves one bounded row of packed
buckets per document, which is written once; corpus counts, gains and
weights come from these rows, so no text is read twice.

A bucket's gain is the floored logarithm of its smoothed share in the target
against that in the corpus; a document weighs the gains of its features; Gumbel
noise of a seeded hash turns the highest ``percent`` of scores into a draw
without replacement.  Ranks come from one range sort of small rows and the
counts of its partitions.  The driver gets ``buckets`` numbers, two totals and
nothing that grows with the corpus.

Defined results: null and empty texts have no features and weigh 0; documents of
fewer than ``least_words`` words get a score but no rank; a null id counts as an
empty string in the hash and comes last among ties; rows alike in id and
text tie, in either order; an empty target leaves gains to the corpus counts
alone; an empty table gives an empty table.  Only id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.alnum import word_blocks
from factweave.llm.common import written


class CrcRing:
    """Running crc32 states of the last ``n`` starts; state k covers the last k + 1 words."""

    def __init__(self, n: int):
        self.n, self.states = n, []

    def extend(self, words: list[bytes]) -> list[list[int]]:
        """The crc32 of every run of 1 to n words that ends in ``words``, per length; runs may begin in earlier calls."""
        spaced = [b" " + w for w in words]
        runs = [list(map(crc32, words))]
        for k in range(1, self.n):
            starts = self.states[k - 1 : k] + runs[-1][:-1]
            runs.append(list(map(crc32, spaced[len(words) - len(starts) :], starts)))
        self.states = [ended[-1] for ended in runs if ended]
        return runs


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def scan_text(text: bytes | None, n: int = 3, buckets: int = 10_000) -> tuple[int, int, np.ndarray | None, np.ndarray | None]:
    """Words, features, and the bucket of each feature in any order; of more features than buckets, counts per bucket in their place."""
    ring, n_words, n_features, listed, counts = CrcRing(n), 0, 0, [], None
    for words in word_blocks(text):
        n_words += len(words)
        hits = (np.fromiter(chain.from_iterable(ring.extend(words)), np.uint32) % np.uint32(buckets)).astype(_kind(buckets))
        n_features += len(hits)
        listed.append(hits)
        if counts is not None or n_features > buckets:
            counts = sum((np.bincount(h, minlength=buckets) for h in listed), np.zeros(buckets, np.int64) if counts is None else counts)
            listed = []
    if counts is not None:
        return n_words, n_features, None, counts.astype("<i8")
    return n_words, n_features, np.concatenate(listed) if listed else np.empty(0, _kind(buckets)), None


FEATURES = "doc_id long, n_words long, n_features long, hits binary, counts binary"
#: Rows that a task hands on at a time.
ROWS = 1000


def hashed_features(docs: DataFrame, *, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, and its features' buckets as packed integers.

    ``hits`` names the bucket of each feature; texts with more features than
    buckets have ``counts`` per bucket instead, so a row is bounded.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [scan_text(text.as_py(), n, buckets) for text in part.column(1).cast(pa.binary())]
                words, features, hits, counts = zip(*found, strict=True)
                packed = lambda arrays: pa.array([None if a is None else a.tobytes() for a in arrays], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), packed(hits), packed(counts)],
                    names=["doc_id", "n_words", "n_features", "hits", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, FEATURES)


def _rows_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed integers of a column in a row, and where each row's start (one more for the end)."""
    column = column.fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return data, (ends - ends[0]) // kind.itemsize


def bucket_totals(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sums its rows before anything is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_rows_of(batch.column(0), _kind(buckets))[0], minlength=buckets)
            total += _rows_of(batch.column(1), np.dtype("<i8"))[0].reshape(-1, buckets).sum(axis=0)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(total[places])], names=["bucket", "n"])

    sums = features.select("hits", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: the floor of 1000 times the logarithm of its target share over its corpus share, add-one smoothed."""
    size, whole, wanted = len(corpus), float(int(corpus.sum())), float(int(target.sum()))
    ratio = [(float(t) + 1.0) * (whole + size) / ((float(s) + 1.0) * (wanted + size)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per row of ``features``: doc_id, n_words, n_features, weight."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, ends = _rows_of(batch.column(3), _kind(len(gain)))
            weights = np.diff(np.concatenate([[0], np.cumsum(gain[hits])])[ends])
            counts, ends = _rows_of(batch.column(4), np.dtype("<i8"))
            weights[np.diff(ends) > 0] = counts.reshape(-1, len(gain)) @ gain
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(weights.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, *, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with the rank of the drawn rows.

    Rows are range-sorted once with their place in their partition; a row per partition gives the ranks before it.
    """
    takes_part = F.col("n_words") >= least_words
    order = [takes_part.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = written(
        scored.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked",
    )
    drawn = placed.where(takes_part).count() * percent // 100
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at") + 1
    return placed.join(parts, "part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(takes_part & (rank <= drawn), rank).cast("long").alias("rank"))


def importance_draw(
    docs: DataFrame, target: DataFrame, *, n: int = 3, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    ``target`` has a column text; the draw leans to documents that resemble its texts.
    """
    features = written(hashed_features(docs, n=n, buckets=buckets), "features")
    aim = hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n=n, buckets=buckets)
    gain = gains(bucket_totals(features, buckets), bucket_totals(aim, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(chance))).cast("long")
    scored = written(weighed(features, gain).withColumn("score", F.col("weight") + noise), "scores")
    return ranked(scored, percent=percent, least_words=least_words)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, own columns; an id is expected to name one row (rows of one id go or stay together)."""
    drawn = importance_draw(docs, target, **options).where("rank IS NOT NULL").select("doc_id")
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["doc_id"]), "left_semi")
