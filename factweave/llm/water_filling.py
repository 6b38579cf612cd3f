r"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources are ordered by code point (null last) and weigh ``weights`` in turn.
Together they are to give ``share`` times the words of all sources; a source
stops at ``max_epochs`` times its own words, and what it can't take is shared
again by weight.  The level is the root of a piecewise linear function of one
row per source, so it needs no iteration: sources sorted by cap/weight.

Documents are taken floor(rate) times whole; the fraction that is left is
taken by systematic sampling: in the order of a seeded hash, documents whose
words end within the fraction's words get one repetition more, so a source
misses its target by less than one document.  The running sum of a source is
split into slices of the hash (sums per slice first), so that no task holds a
source.

Defined results: a null text has size 0; a null source is a source; a source
without words has target 0 and takes nothing; documents with equal id and
text that straddle the edge are told apart by nothing, and either may be
taken; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import n_words, written

#: Rows of a slice, about; a slice is what the first hex digits of the hash name, two at least.
SLICE_ROWS = 100_000


def source_targets(
    sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2
) -> DataFrame:
    """Per source: source, source_size, target.  The windows here hold one small row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.pmod(
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    capped = by_source.select(
        "source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * max_epochs).alias("cap")
    )
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    sums = capped.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("wanted"),
    )
    # The level lies in the first stretch whose end reaches what is wanted.
    reached = F.col("cap_before") + F.col("cap") / F.col("w") * F.col("w_left") >= F.col("wanted")
    level = F.min(
        F.when(reached, F.struct(F.col("cap_before").alias("at"), ((F.col("wanted") - F.col("cap_before")) / F.col("w_left")).alias("level")))
    ).over(everything)["level"]
    cap = F.col("cap").cast("double")
    return sums.select(
        "source", "source_size", F.coalesce(F.least(cap, level * F.col("w")), cap).alias("target")
    )


def _draw(seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _drawn(docs: DataFrame, seed: int, **options) -> DataFrame:
    """Per row: its size and draw, its source's whole repeats, and whether it is taken once more."""
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _draw(seed).alias("draw"))
    sizes = written(sizes, "sizes")
    digits = max(2, math.ceil(math.log(max(1, sizes.count() / SLICE_ROWS), 16)))
    sizes = sizes.withColumn("slice", F.substring("draw", 1, digits))
    targets = source_targets(sizes, **options)
    per_slice = sizes.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = per_slice.select(
        "source", "slice", F.coalesce(F.sum("slice_size").over(running), F.lit(0)).alias("slice_start")
    )
    plan = slices.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("p_source"), F.col("a.slice").alias("p_slice"), "slice_start", "source_size", "target"
    )
    within = (
        Window.partitionBy("source", "slice").orderBy("draw", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = sizes.withColumn("slice_end", F.sum("size").over(within))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["p_source"]) & (placed["slice"] == plan["p_slice"]))
    size = F.col("source_size")
    whole = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.col("target") / size))
    part = F.col("target") - whole * size
    end = F.col("slice_start") + F.col("slice_end")
    extra = (F.col("size") > 0) & (end * 2 - F.col("size") <= part * 2)
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "draw", whole.cast("long").alias("whole"), extra.alias("extra")
    )


def mix(docs: DataFrame, *, seed: int = 8, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, repeats, taken."""
    repeats = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(F.lit(0).cast("long"))
    return _drawn(docs, seed, **options).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken")
    )


def resample(docs: DataFrame, *, seed: int = 8, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; own columns.

    Along the draw, the documents taken once more come first, so one cutoff a
    source tells them.  The table of cutoffs has a row per source; Spark
    broadcasts it if its size is known to be small, and joins by source else.
    Rows alike in id, source and size are taken alike.
    """
    place = F.struct("draw", "doc_id", "size")
    cutoffs = written(
        _drawn(docs, seed, **options).groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("extra"), place)).alias("last"))
        .withColumnRenamed("source", "cut_source"),
        "cutoffs",
    )
    # The row travels whole in one column, so its own columns meet no name of ours.
    place = F.struct(_draw(seed).alias("draw"), F.col("doc_id"), n_words(F.col("text")).alias("size"))
    joined = docs.select(F.struct("*").alias("row"), F.col("source").alias("own_source"), place.alias("place")).join(cutoffs, F.col("own_source").eqNullSafe(F.col("cut_source")))
    extra = (F.col("place.size") > 0) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False))
    repeats = F.when(F.col("place.size") > 0, F.col("whole") + extra.cast("long")).otherwise(0).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), repeats)).alias("copy")).select("row.*")
