r"""MinHash near-duplicates with tensored banding and exact confirmation.

A table's key is a pair (i, j) of sub-keys from two small collections of
``per_side`` sub-keys, each of two minhashes: ``per_side``\ :sup:`2` tables of
four minhashes from 4 * per_side minhashes.  ``per_side`` follows from the
threshold, so that a pair at it shares no table with probability 1e-5 at most
(10 and 5e-6 at 0.85, 12 and 9e-6 at 0.80).

Texts with equal shingle sets form one class, which is one node.  A sub-key
that only one class has can't be half of a shared table key, so it is left
out before keys are combined.  In each table bucket members are compared
with a leader only, and linked members fall into one component; the next
rounds lead by the best linked member.  What is left at the end (members of
buckets in which components met but did not merge) goes through tougher
tables and sketches, and every pair that these can't rule out is compared.
Links are confirmed on full sets.  Nothing is capped.

Defined results: documents without words (null, empty, blank texts) have an
empty set, no links and are their own component; repeated rows are copies of
each other; a null id takes part but is never a component's smallest id
unless there is no other, and then the component is null and the row is kept;
an empty table gives an empty table.  Only id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import written
from factweave.llm.components import components
from factweave.llm.shingles import odd_factors, shingle_set

BLOCK = 2048


def _minhashes(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The high half of the least value of each hash function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[i : i + BLOCK, None] * factors + offsets).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, *, per_side: int = 10, width: int = 5, seed: int = 10) -> DataFrame:
    """Per row: doc_id, n_shingles, digest (128 bits of the set; null if empty), minhashes."""
    count = 4 * per_side

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = odd_factors(count, seed), odd_factors(count, seed + 1)
        for batch in batches:
            sizes, digests, mins = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                mins.append(_minhashes(s, factors, offsets).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(mins, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "digest", "minhashes"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, minhashes array<int>")


def _sub_keys(per_side: int) -> Column:
    """Both collections: structs of side and key; a key holds its place, so places don't mix."""
    m = F.col("minhashes")
    return F.array(*[
        F.struct(F.lit(i >= per_side).alias("side"), F.xxhash64(F.lit(i), F.get(m, 2 * i), F.get(m, 2 * i + 1)).alias("key"))
        for i in range(2 * per_side)
    ])


def table_keys(classes: DataFrame, *, per_side: int = 10) -> DataFrame:
    """(table_key, node) of the classes that share both sub-keys of the key with any others."""
    subs = classes.select("node", F.explode(_sub_keys(per_side)).alias("s")).select("node", "s.side", "s.key")
    shared = subs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = subs.join(shared, "key").groupBy("node").agg(
        F.collect_list(F.when(~F.col("side"), F.col("key"))).alias("left"),
        F.collect_list(F.when(F.col("side"), F.col("key"))).alias("right"),
    )
    return live.select("node", F.explode("left").alias("l"), "right").select(
        "node", "l", F.explode("right").alias("r")
    ).select(F.xxhash64("l", "r").alias("table_key"), "node")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return (
        pairs.join(left, "a").join(right, "b")
        .where((F.size("sa") * 100 >= F.size("sb") * percent) & (F.size("sb") * 100 >= F.size("sa") * percent))
        .select("a", "b", "sa", "sb", shared.alias("shared"))
        .where(F.col("shared") * 100 >= union * percent)
        .select("a", "b")
    )


SKETCH_BITS, SKETCH_DEVIATIONS = 2048, 4.5


def first_tables(percent: int) -> int:
    """Sub-keys per side: a pair at the threshold shares none on one of the sides with probability 1e-5 at most."""
    return max(1, math.ceil(math.log(5e-6) / math.log1p(-min(0.999, (percent / 100) ** 2))))


def last_tables(percent: int) -> tuple[int, int]:
    """The last round's tables and minhashes in each: a pair at the threshold shares none with probability 1.1e-5 at most."""
    rows = max(r for r in range(1, 25) if r == 1 or (percent / 100) ** r >= 0.13)
    return max(1, math.ceil(math.log(1.1e-5) / math.log1p(-min(0.999, (percent / 100) ** rows)))), rows


def _close_pairs(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes with different roots that a sharper sketch can't tell from linked ones.

    ``crowded`` holds the nodes of buckets in which components met but didn't
    merge: mostly copies edited a little too much.  Pairs of them share first
    tables too easily, so they must share one of tougher tables (the first that
    they share gives the pair) and agree on one-bit sketches to within
    SKETCH_DEVIATIONS of what links do.  Shingles that no other of these nodes
    has can't be shared, which bounds the similarity of a node, and of a pair,
    exactly.
    """
    own = crowded.join(sets, "node")
    once = own.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    private = once.groupBy("node").agg(F.count("*").cast("int").alias("private"))
    own = own.join(private, "node", "left").select(
        "node", "root", "shingles", F.size("shingles").alias("n"), (F.size("shingles") - F.coalesce("private", F.lit(0))).alias("common")
    ).where(F.col("common") * 100 >= F.col("n") * percent)

    n_tables, n_rows = last_tables(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = odd_factors(SKETCH_BITS, 21), odd_factors(SKETCH_BITS, 22)
        for batch in batches:
            keys, bits = [], []
            for value in batch.column(2):
                mins = _minhashes(value.values.to_numpy().view(np.uint64), factors, offsets)
                bits.append(np.packbits((mins & np.uint32(1)).astype(np.uint8)).view(np.int64))
                rows = mins[: n_tables * n_rows].reshape(n_tables, n_rows)
                keys.append([
                    int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8, key=i.to_bytes(2, "big")).digest(), "big", signed=True)
                    for i, r in enumerate(rows)
                ])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3, 4)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["node", "root", "n", "common", "keys", "bits"],
            )

    sketched = written(
        own.mapInArrow(sketch, "node long, root long, n int, common int, keys array<long>, bits array<long>"), "sketches"
    )
    tables = sketched.select("node", "root", F.posexplode("keys").alias("place", "key"))
    mixed_keys = tables.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    short = sketched.withColumn("keys", F.transform("keys", lambda k: k.bitwiseAND(0xFFFFFFFF)))
    short = short.withColumn("keys", F.transform("keys", lambda k: F.when(k > 0x7FFFFFFF, k - 0x100000000).otherwise(k).cast("int")))
    left = tables.join(mixed_keys, "key").select("key", "place", "node").join(short, "node")
    right = left.select(
        "key", F.col("node").alias("b"), F.col("root").alias("other_root"), F.col("bits").alias("other_bits"),
        F.col("n").alias("other_n"), F.col("common").alias("other_common"), F.col("keys").alias("other_keys"),
    )
    share = (1 - percent / 100) / 2  # of bits that differ at the threshold
    most = SKETCH_BITS * share + SKETCH_DEVIATIONS * (SKETCH_BITS * share * (1 - share)) ** 0.5
    differ = sum((F.bit_count(F.get("bits", i).bitwiseXOR(F.get("other_bits", i))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    room = F.least("common", "other_common") * (100 + percent) >= (F.col("n") + F.col("other_n")) * percent
    earlier = F.exists(F.sequence(F.lit(0), F.col("place")), lambda j: (j < F.col("place")) & (F.get("keys", j) == F.get("other_keys", j)))
    close = (F.col("root") != F.col("other_root")) & (F.col("node") < F.col("b")) & room & (differ <= most) & ~earlier
    return left.join(right, (left["key"] == right["key"]) & close).select(F.col("node").alias("a"), "b")


def _set_rows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted classes, from the text of one document each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, digest, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                s = shingle_set(text.as_py(), width)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest.as_py():
                    nodes.append(node.as_py())
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    texts = docs.select(F.col("doc_id").alias("first_id"), "text")
    found = wanted.join(texts, wanted["first_id"].eqNullSafe(texts["first_id"])).select("node", "digest", "text")
    return found.mapInArrow(read, "node long, shingles array<long>").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame, *, percent: int = 85, per_side: int | None = None, width: int = 5, hub_rounds: int = 1
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, digest, class_id, n_links (of its class), component_id, kept."""
    per_side = per_side or first_tables(percent)
    signed = written(signatures(docs, per_side=per_side, width=width), "signatures")
    classes = written(
        signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("minhashes").alias("minhashes"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    members = table_keys(classes, per_side=per_side)
    buckets = members.groupBy("table_key").agg(F.count("*").alias("n")).where("n > 1").select("table_key")
    members = written(members.join(buckets, "table_key"), "tables")
    nodes = written(members.select("node").distinct(), "nodes")
    sets = written(_set_rows(docs, nodes.join(classes.select("node", "digest", "first_id"), "node"), width), "sets")

    links, roots, degrees = None, nodes.withColumn("root", F.col("node")), nodes.select("node", F.lit(0).alias("d"))
    for turn in range(hub_rounds + 2):
        at = members.join(roots, "node") if turn else members.withColumn("root", F.col("node"))
        if turn:  # buckets that hold one component are settled for good
            open_keys = at.groupBy("table_key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("table_key")
            at = written(at.join(open_keys, "table_key"), "open")
            members = at.select("table_key", "node")
            if at.isEmpty():
                break
        if turn > hub_rounds:
            pairs = _close_pairs(at.select("node", "root").distinct(), sets, percent)
        else:
            best = at.join(degrees, "node").groupBy("table_key").agg(F.max(F.struct("d", "node", "root")).alias("lead"))
            pairs = at.join(best, "table_key").where(F.col("root") != F.col("lead.root")).select(
                F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        new = written(_confirmed(pairs.select("a", "b").distinct(), sets, percent), "links")
        links = new if links is None else links.union(new).distinct()
        degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("d"))
        degrees = nodes.join(degrees, "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d"))
        roots = written(nodes.join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")

    placed = classes.select("digest", "node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(first, "root").join(degrees, "node", "left").select(
        "digest", F.col("first_id").alias("class_id"), "component_id", F.coalesce("d", F.lit(0)).alias("n_links")
    )
    columns = ("doc_id", "n_shingles", "digest", "class_id", "n_links", "component_id")
    out = signed.where(F.col("digest").isNotNull()).join(placed, "digest").select(*columns)
    # Documents without a set are no join's business: their null digests would meet in one task.
    alone = signed.where(F.col("digest").isNull()).select(
        "doc_id", "n_shingles", "digest", F.col("doc_id").alias("class_id"), F.lit(0).alias("n_links"), F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those that copy or nearly copy a kept one; own columns.

    Rows of one id and one text count as one; an id is expected to name one text.
    """
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    # The row travels whole in one column, so its own columns meet no name of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["id", "digest"]).select("row.*")
