r"""Ranked lexical search with variable-sized blocks and block maxima.

``build_index`` cuts the corpus into shards of about ``shard_bytes`` of text, each
made by one task where its texts lie, and writes one row per shard and term
(documents by their place in the shard, and term counts) and one per shard with its ids and
sizes.  No text is shuffled.  ``search`` takes the queries in blocks of bounded
bytes and reads only the rows of their terms.  Per shard, dynamic programming
cuts each posting list where blocks' maxima overstate their postings least,
each block paying a fixed cost; the search then sums, for every stretch
between boundaries, the maxima of the blocks that cover it, and scores
stretches from the highest bound down until the bound falls below the k-th
best score.  Whatever is skipped is below that score, so results are exact,
ties included.  The best of the shards are ranked per query.

All scores are integers: see ``weight_of`` and ``_impacts``.

Defined results: null and empty texts hold no term, are not counted and never found;
each row is a document, so repeated rows are found side by side; null ids come last among
equal scores; each row of queries is a query of its own, whatever its id, and one
without terms, or without a document that scores above 0, has no rows; an empty corpus has none.
Only ids and texts are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.alnum import word_blocks
from factweave.llm.common import written

INDEX = "shard long, term string, n long, places array<int>, counts array<int>, ids array<long>, sizes array<long>"
#: A boundary may stand before every so many postings, and a block holds at most SPAN such grains.
GRAIN, SPAN = 8, 64


class _Numbers(dict):
    """Terms numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = len(self)
        return self[term]


class _Shard:
    """Documents gathered by a task until they are written as one shard."""

    def __init__(self) -> None:
        self.numbers, self.bytes = _Numbers(), 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        counter: Counter[bytes] = Counter()
        for words in word_blocks(text):
            counter.update(words)
        if counter:
            n = len(counter)
            self.ids.append(doc_id)
            self.sizes.append(counter.total())
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, counter), np.int64, n))
            self.counts.append(np.fromiter(counter.values(), np.int64, n))
            self.bytes += len(text)

    def rows(self, shard: int) -> pa.RecordBatch:
        """The shard's table of documents (no term), then a row per term in the order of the bytes."""
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names))
        terms = rank[np.concatenate(self.terms)]
        places = np.repeat(np.arange(len(self.ids), dtype=np.int32), list(map(len, self.terms)))
        order = np.argsort(terms, kind="stable")
        ends = np.concatenate([[0, 0], np.cumsum(np.bincount(terms, minlength=len(names)))]).astype(np.int32)
        listed = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order].astype(np.int32)))
        blank = [None] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * (len(names) + 1), pa.int64()), pa.array([None, *(t.decode() for t in names)], pa.string()),
             pa.array(np.diff(ends).astype(np.int64)), listed(places), listed(np.concatenate(self.counts)),
             pa.array([self.ids, *blank], pa.list_(pa.int64())), pa.array([self.sizes, *blank], pa.list_(pa.int64()))],
            names=["shard", "term", "n", "places", "counts", "ids", "sizes"],
        )


def build_index(docs: DataFrame, *, shard_bytes: int = 16 << 20) -> DataFrame:
    """The written index of ``docs`` (doc_id, text), sharded where the texts lie."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 24, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.bytes >= shard_bytes:
                    yield shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.rows(number)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(gather, INDEX), "index")


def weight_of(documents: int, holding: int) -> int:
    """A term's weight, from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _impacts(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 8 * lengths)


def block_starts(lists: list[np.ndarray], *, block_cost: float = 16.0, grain: int = GRAIN, span: int = SPAN) -> list[np.ndarray]:
    """Per list of impacts: where blocks start so that sum(size * maximum - postings) + cost * blocks is least.

    A block costs as much as ``block_cost`` mean postings of its list.  Starts are
    multiples of ``grain``.  All lists take a step of the dynamic program at a
    time, the longest first; a step looks back over ``span`` grains.
    """
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    sizes = np.array([len(lists[i]) for i in order], np.int64)
    grains = -(-sizes // grain)
    offsets = np.concatenate([[0], np.cumsum(grains)])
    most = np.concatenate([np.maximum.reduceat(lists[i], np.arange(0, len(lists[i]), grain)) for i in order]).astype(np.float64)
    cost = block_cost * np.array([lists[i].mean() for i in order])
    back = np.zeros(len(most), np.int64)  # of a grain: where the block that ends with it starts
    shape = (len(lists), span)
    before, start, highest = np.full(shape, np.inf), np.zeros(shape), np.zeros(shape)
    best, number = np.zeros(len(lists)), np.zeros(span, np.int64)
    for j in range(1, int(grains[0]) + 1):
        live, slot = int(np.searchsorted(-grains, -j, side="right")), (j - 1) % span
        number[slot] = j - 1
        before[:live, slot], start[:live, slot], highest[:live, slot] = best[:live], (j - 1) * grain, 0
        at = offsets[:live] + j - 1
        np.maximum(highest[:live], most[at, None], out=highest[:live])
        total = before[:live] + (np.minimum(j * grain, sizes[:live])[:, None] - start[:live]) * highest[:live]
        choice = total.argmin(axis=1)
        best[:live] = total[np.arange(live), choice] + cost[:live]
        back[at] = number[choice]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(lists)
    for rank, i in enumerate(order):
        starts, j = [], int(grains[rank])
        while j:
            j = int(back[offsets[rank] + j - 1])
            starts.append(j * grain)
        out[i] = np.array(starts[::-1], np.int64)
    return out


class Postings:
    """A term's list in one shard, cut into blocks."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray, starts: np.ndarray):
        self.places, self.impacts = places, impacts
        self.last = places[np.append(starts[1:], len(places)) - 1]
        self.most = np.maximum.reduceat(impacts, starts)

    def bounds(self, ends: np.ndarray) -> np.ndarray:
        """The block maximum over each stretch that ends at ``ends``; 0 behind the last block."""
        return np.append(self.most, 0)[np.searchsorted(self.last, ends)]

    def score(self, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        return np.where(self.places[at] == wanted, self.impacts[at], 0)


def best_of_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents for weighted lists, equal scores by the order of ``ids`` (ranks)."""
    ends = np.unique(np.concatenate([p.last for _, p in lists]))
    bounds = sum(w * p.bounds(ends) for w, p in lists)
    order = np.argsort(-bounds, kind="stable")
    begins = np.concatenate([[0], ends[:-1] + 1])
    places, scores, floor, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 1, 0, 4
    while at < len(order) and bounds[order[at]] >= floor:
        batch = order[at : at + step]
        batch = batch[bounds[batch] >= floor]
        sizes = ends[batch] - begins[batch] + 1
        wanted = np.repeat(begins[batch] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        got = sum(w * p.score(wanted) for w, p in lists)
        places, scores = np.concatenate([places, wanted]), np.concatenate([scores, got])
        top = np.lexsort((ids[places], -scores))[:k]
        places, scores = places[top], scores[top]
        if len(top) == k:
            floor = max(1, int(scores[-1]))
        at, step = at + step, step * 2
    return places[scores > 0], scores[scores > 0]


def _query_terms(text: str | None) -> list[str]:
    return sorted({w.decode() for words in word_blocks((text or "").encode()) for w in words})


def _searcher(asked: list[tuple[int, list[tuple[int, int]]]], documents: int, length: int, k: int):
    """Per shard: the k best documents of each query of ``asked`` (number; numbers and weights of its terms)."""

    def run(table: pa.Table) -> pa.Table:
        names, lists, ids, norms = [], [], [], None
        rows = table.to_batches()
        for batch in rows:
            for row in range(batch.num_rows):
                if not batch.column(1)[row].is_valid:
                    ids = batch.column(4)[row].as_py()
                    norms = np.array([100 - 90 + 90 * n * documents // length for n in batch.column(5)[row].as_py()], np.int64)
        for batch in rows:
            for row in range(batch.num_rows):
                if batch.column(1)[row].is_valid:
                    places = batch.column(2)[row].values.to_numpy().astype(np.int64)
                    counts = batch.column(3)[row].values.to_numpy().astype(np.int64)
                    names.append(batch.column(1)[row].as_py())
                    lists.append((places, _impacts(counts, norms[places])))
        starts = block_starts([impacts for _, impacts in lists]) if lists else []
        known = {name: Postings(*at, cut) for name, at, cut in zip(names, lists, starts, strict=True)}
        by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        query, doc_ids, scores = [], [], []
        for number, terms in asked:
            held = [(w, known[t]) for t, w in terms if t in known and w]
            if held:
                places, got = best_of_shard(held, rank, k)
                query += [number] * len(got)
                doc_ids += [ids[p] for p in places]
                scores.append(got)
        return pa.table({"query": pa.array(query, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()),
                         "score": pa.array(np.concatenate(scores) if scores else [], pa.int64())})

    return run


def search(index: DataFrame, queries: DataFrame, *, item: str = "item_id", k: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The k best documents per row of ``queries`` (``item``, text): item, rank, doc_id, score.

    Queries are taken in blocks of about ``block_bytes`` of text; only one block
    and its terms' weights are at the driver and in tasks at a time, and each
    block reads the index rows of its terms once.
    """
    spark = index.sparkSession
    shards = index.where("term IS NULL")
    sums = shards.select(F.col("ids"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("length")).agg(
        F.sum(F.size("ids")).alias("documents"), F.sum("length").alias("length")).first()
    documents, length = int(sums["documents"] or 0), int(sums["length"] or 0)
    text_bytes = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-text_bytes // block_bytes)
    out = None
    for block in range(blocks if documents else 0):
        part = F.pmod(F.xxhash64(item, "text"), F.lit(blocks)) == block
        rows = [(i, row[0], _query_terms(row[1])) for i, row in enumerate(queries.where(part).select(item, "text").collect())]
        numbers = {t: i for i, t in enumerate(sorted({t for _, _, terms in rows for t in terms}))}
        if not numbers:
            continue
        known = F.broadcast(spark.createDataFrame([*numbers.items()], "term string, number int"))  # within block_bytes
        hits = index.select("shard", "term", "n", "places", "counts").join(known, "term")
        holding = dict(hits.groupBy("number").agg(F.sum("n")).collect())  # a row per term of the block
        asked = [(i, [(numbers[t], weight_of(documents, holding[numbers[t]])) for t in terms if numbers[t] in holding]) for i, _, terms in rows]
        nothing = F.lit(None)
        per_shard = hits.select("shard", "number", "places", "counts", nothing.cast("array<long>").alias("ids"), nothing.cast("array<long>").alias("sizes")).union(
            shards.select("shard", nothing.cast("int"), nothing.cast("array<int>"), nothing.cast("array<int>"), "ids", "sizes"))
        found = per_shard.groupBy("shard").applyInArrow(_searcher(asked, documents, length, k), "query long, doc_id long, score long")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(i, name) for i, name, _ in rows], f"query long, item {queries.schema[item].dataType.simpleString()}"))
        ranked = written(ranked.join(names, "query").select(F.col("item").alias(item), "rank", "doc_id", "score"), "hits")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        return spark.createDataFrame([], f"{item} {queries.schema[item].dataType.simpleString()}, rank int, doc_id long, score long")
    return out
