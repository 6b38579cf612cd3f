r"""Removal of repeated 50-byte strings with a logarithmic family of sparse suffix arrays.

Every window of ``length`` bytes has an anchor: its leftmost least-hashed
``gram`` bytes.  Equal windows have equal anchors at equal places, so a sparse
suffix array that lists the suffixes at anchors only (about 7 % of all) misses
no match of ``length`` bytes or more.  Windows that share an anchor follow
each other; the bytes they cover are its context.

1. Texts are copied to a table of shards of about ``shard_bytes``, bucketed by
   shard, so that later passes join answers to texts without moving texts.
2. Shards arrive in batches, more of them the more shards there are.  A
   batch's suffix arrays (the first ``gram`` bytes of each suffix, shard and
   position, in the order of the bytes, split by a hash of these bytes) are
   merge-scanned against each existing level: where neighbours of different
   shards have a longest common prefix of ``gram`` bytes, both shards hear of
   it.  Then the batch becomes a level, and levels of equal size merge, so
   there are at most log2(batches) levels.
3. Shards ask for the smallest id of each context of such anchors, and whether
   an anchor has more than one context.  An occurrence is repeated as a whole
   if a smaller id has its context.
4. Only first owners of contexts whose anchor has several ask window by window.

A question is asked once per shard and distinct key, so a passage that a
third of all documents share costs each bucket no more than a row a shard.
Contexts and windows are known by 64 bits of one hash and confirmed by 64 bits
of another, which the owner sends along: where only the first agree, nothing
is removed.

Defined results: a null text is empty; texts under ``length`` bytes lose
nothing; equal ids never remove from each other; a null id counts as larger
than any other; repeated rows repeat; an empty table gives an empty table.
Only id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import drop_path, scratch_path, shuffles_dropped, written
from factweave.llm.shingles import mixed

#: ``gram`` is three words of eight bytes, so that suffixes compare as numbers.
LENGTH, GRAM = 50, 24
SHARD_BYTES = 12 << 20
#: Shards in a batch; few shards are four batches.
BATCH_SHARDS = 85
LAST = np.iinfo(np.int64).max
PLACE_BITS = np.uint64(20)
PLACES = np.uint64((1 << 20) - 1)
STEP = 1 << 16

ANSWER = "shard int, kind string, body binary"
_ANSWER = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("body", pa.binary())])
_QUESTION = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("shard", pa.int32()), ("body", pa.binary())])


#: Odd bases of the first hash and of the confirming one.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@cache
def _powers(which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes; powers of an odd base and of its inverse."""
    base = BASES[which]
    values = np.random.default_rng(9 + which).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    grow = np.multiply.accumulate(np.full(STEP + 8 * LENGTH, base, np.uint64))
    shrink = np.multiply.accumulate(np.full(STEP + 8 * LENGTH, pow(base, -1, 1 << 64), np.uint64))
    return values, grow, shrink


class Runs:
    """Anchors of a shard's texts and the window starts that belong to each.

    Arrays, one entry a run: place of the document, key, context, first and
    last start, place of the anchor.  Texts are read in buffers of about STEP bytes, whatever their
    lengths; windows don't cross texts.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM, bits: int = 64):
        self.length, self.gram, self.bits = length, gram, bits
        empty = (np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int32)] * 3)
        parts = list(zip(empty, *map(self._buffer, self._buffers(texts))))[::-1]
        # Each column's parts go when it is whole.
        self.doc, self.key, self.context, self.first, self.last, self.anchor = (np.concatenate(parts.pop()) for _ in empty)

    def _buffers(self, texts: list[bytes]):
        """Lists of (document, start in it, bytes) of STEP bytes or little more; long texts come in overlapping parts."""
        pieces, size = [], 0
        for i, data in enumerate(texts):
            for at in range(0, len(data) - self.length + 1, STEP):
                part = data if len(data) <= STEP else data[at : at + STEP + self.length - 1]
                if size and size + len(part) > STEP:
                    yield pieces
                    pieces, size = [], 0
                pieces.append((i, at, part))
                size += len(part)
                if part is data:
                    break
        if pieces:
            yield pieces

    def _buffer(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = b"".join(p[2] for p in pieces)
        offsets = np.cumsum([0, *(len(p[2]) for p in pieces)])
        sums, shrink = _sums(data)
        count = len(data) - self.gram + 1
        grams = mixed((sums[self.gram :] - sums[:count]) * shrink[:count])
        least = (grams & ~PLACES) | np.arange(count, dtype=np.uint64)
        need, have = self.length - self.gram + 1, 1
        while 2 * have <= need:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < need:
            least = np.minimum(least[: have - need], least[need - have :])
        # Starts whose windows cross from one text to the next are runs apart, which are left out.
        crossing = offsets[1:-1] - self.length + 1
        edge = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=edge[1:])
        for a in crossing:
            edge[a : a + self.length] = False
        edge[crossing] = edge[offsets[1:-1]] = True
        begins = np.flatnonzero(edge)
        within = np.ones(len(begins), bool)
        within[np.searchsorted(begins, crossing)] = False
        first, last = begins[within], (np.append(begins[1:], len(least)) - 1)[within]
        own = (least[first] & PLACES).astype(np.int64)
        covered = (sums[last + self.length] - sums[first]) * shrink[first]
        shape = ((own - first) * 256 + (last - first)).astype(np.uint64)
        piece = np.searchsorted(offsets, first, side="right") - 1
        shift = (np.array([p[1] for p in pieces]) - offsets[:-1])[piece]
        return (
            np.array([p[0] for p in pieces], np.int32)[piece], _cut(grams[own], self.bits), _cut(mixed(covered + shape * np.uint64(0xD6E8FEB86659FD93)), self.bits),
            *((x + shift).astype(np.int32) for x in (first, last, own)),  # Arrow's texts have under 2^31 bytes
        )


def _cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits``; all of them but in tests."""
    return hashes if bits == 64 else hashes & ~np.uint64((1 << (64 - bits)) - 1)


def _joined(data: list[bytes], docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where places in documents stand in the documents joined."""
    return np.cumsum([0, *map(len, data)])[docs] + places


def _confirming(data: list[bytes], docs: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash by other values and another base of the bytes of each stretch; stretches in the order of the texts."""
    return _stretches(b"".join(data), _joined(data, docs, first), _joined(data, docs, end), 1)


def _prefixes(whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[3, n]: the GRAM bytes of each suffix as numbers in the order of the bytes."""
    if not len(at):
        return np.empty((3, 0), np.uint64)
    grams = np.ndarray(len(whole) - GRAM + 1, f"V{GRAM}", whole, strides=(1,))
    return grams[at].view(">u8").reshape(-1, 3).astype(np.uint64).T


def _prefix_keys(words: np.ndarray) -> np.ndarray:
    """The keys of anchors from their bytes."""
    values, grow, shrink = _powers()
    data = np.ascontiguousarray(words.T.astype(">u8")).view(np.uint8)
    return mixed((values[data] * (grow[:GRAM] * shrink[0])).sum(axis=1, dtype=np.uint64))


def _suffix_order(words: np.ndarray) -> np.ndarray:
    """Stable, and linear where a few sorted arrays follow each other."""
    return np.argsort(np.ascontiguousarray(words.T.astype(">u8")).view(f"S{GRAM}").ravel(), kind="stable")


def _common_prefixes(words: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of a sorted array shares with the one before it; 0 for the first."""
    out = np.zeros(words.shape[1], np.int64)
    if words.shape[1] > 1:
        differ = words[:, 1:] ^ words[:, :-1]
        for w in differ[::-1]:
            # A word that differs has its highest set bit in the first byte that does.
            leading = np.full(len(w), 8, np.int64)
            for byte in range(8):
                leading[(w >> np.uint64(8 * byte)) != 0] = 7 - byte
            out[1:] = np.where(w == 0, 8 + out[1:], leading)
    return out


def _sums(data: bytes, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of byte values times powers; a stretch's hash is its difference times the inverse power."""
    values, grow, shrink = _powers(which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[np.frombuffer(data, np.uint8)] * grow[: len(data)], out=sums[1:])
    return sums, shrink


def _stretches(data: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of stretches of at most 8 * LENGTH bytes; their starts ascend."""
    out = [np.empty(0, np.uint64)]
    most = int((ends - starts).max(initial=0))
    for at in range(0, len(data), STEP):
        own = slice(*np.searchsorted(starts, (at, at + STEP)))
        if own.start < own.stop:
            sums, shrink = _sums(data[at : at + STEP + most], which)
            out.append((sums[ends[own] - at] - sums[starts[own] - at]) * shrink[starts[own] - at])
    return np.concatenate(out)


def window_hashes(data: bytes, starts: np.ndarray, length: int, bits: int = 64) -> np.ndarray:
    """Hashes of the windows at the given ascending starts."""
    return _cut(mixed(_stretches(data, starts, starts + length)), bits)


def _texts(table: pa.Table) -> list[tuple[int, bytes]]:
    """(rank of the id, bytes) of each document of a shard."""
    return [
        (LAST if d is None else d, (t.as_py() or "").encode("utf-8", "surrogatepass"))
        for d, t in zip(table.column("doc_id").to_pylist(), table.column("text"))
    ]


def _least(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the least of each value per key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[starts], *(np.minimum.reduceat(v[order], starts) for v in values))


#: A first test of membership by as many bits of a key.
SIEVE_BITS = 22


def _sieved(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of keys that may be in ``known``: all that are, few others."""
    shift = np.uint64(64 - SIEVE_BITS)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[known >> shift] = True
    return np.flatnonzero(sieve[keys >> shift])


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``known``."""
    out = np.zeros(len(keys), bool)
    if len(known):
        maybe = _sieved(keys, known)
        own = keys[maybe]
        out[maybe] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
    return out


def _places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted ``known``; -1 if nowhere."""
    out = np.full(len(keys), -1, np.int64)
    if len(known):
        maybe = _sieved(keys, known)
        own = keys[maybe]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        out[maybe] = np.where(known[at] == own, at, -1)
    return out


def _asked(kind: str, shard: int, buckets: int, keys: np.ndarray, *columns: np.ndarray, keep_keys: bool = True) -> list[tuple]:
    """Rows of _QUESTION: sorted keys split by bucket, each column as eight bytes a value."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    sorted_columns = [c[order].view(np.uint64) for c in ((keys, *columns) if keep_keys else columns)]
    return [
        (kind, b, shard, np.concatenate([c[cuts[b] : cuts[b + 1]] for c in sorted_columns]).tobytes())
        for b in range(buckets) if cuts[b] < cuts[b + 1]
    ]


def _columns(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, np.uint64).reshape(n, -1)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _of_kind(answers: pa.Table, kind: str, n: int) -> np.ndarray:
    """All columns of one kind of answer; sorted by key."""
    found = [_columns(b, n) for k, b in zip(answers.column("kind").to_pylist(), answers.column("body").to_pylist()) if k == kind]
    whole = np.concatenate(found, axis=1) if found else np.empty((n, 0), np.uint64)
    return whole[:, np.argsort(whole[0])]


# Levels: rows (bucket, prefixes, shards, places) are suffix arrays.  First words of prefixes are stored as differences, which compress.

LEVEL = "bucket int, prefixes binary, shards binary, places binary"
_LEVEL = pa.schema([("bucket", pa.int32()), ("prefixes", pa.binary()), ("shards", pa.binary()), ("places", pa.binary())])
Suffixes = tuple[np.ndarray, np.ndarray, np.ndarray]


def _level_row(bucket: int, words: np.ndarray, shards: np.ndarray, places: np.ndarray) -> pa.Table:
    """Sort suffixes to one row."""
    order = _suffix_order(words)
    words = words[:, order]
    words[0] = np.diff(words[0], prepend=np.uint64(0))
    return _table([(bucket, words.tobytes(), shards[order].astype(np.uint32).tobytes(), places[order].astype(np.uint32).tobytes())], _LEVEL)


def _level_arrays(table: pa.Table) -> Suffixes:
    words = [np.frombuffer(x, np.uint64).reshape(3, -1).copy() for x in table.column("prefixes").to_pylist()]
    if not words:
        return np.empty((3, 0), np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
    for w in words:
        np.cumsum(w[0], out=w[0])
    return np.concatenate(words, axis=1), *(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]) for c in ("shards", "places"))


def _both(a: Suffixes, b: Suffixes) -> Suffixes:
    return np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])


def _seeds(suffixes: Suffixes, new: int | None = None) -> pa.Table:
    """Answers 'seed': for each shard, the keys of its anchors that share GRAM bytes with another shard's.

    Of anchors that none of the first ``new`` suffixes has, earlier scans told.
    """
    words, shards, _ = suffixes
    order = _suffix_order(words)
    words, shards, fresh = words[:, order], shards[order], order < (len(order) if new is None else new)
    # Neighbours that differ in the first two words share less.
    alike = (words[:2, 1:] == words[:2, :-1]).all(axis=0)
    near = np.flatnonzero(np.append(alike, False) | np.append(False, alike)) if len(shards) else []
    words, shards = words[:, near], shards[near]
    same = np.append(_common_prefixes(words) >= GRAM, False)
    group = np.cumsum(~same[:-1])
    twin = (same[:-1] | same[1:]) & (np.bincount(group, fresh[near]) > 0)[group]
    keys, shards = _prefix_keys(words[:, twin]), shards[twin]
    order = np.argsort(shards, kind="stable")
    keys, shards = keys[order], shards[order]
    own, starts = np.unique(shards, return_index=True)
    ends = [*starts[1:], len(keys)]
    return _table([(int(s), "seed", _distinct(keys[a:b]).tobytes()) for s, a, b in zip(own, starts, ends)], _ANSWER)


class LogIndex:
    """Levels of merged batches, each a bucketed table; sizes double from level to level."""

    def __init__(self, spark, name: str):
        self.spark, self.name, self.buckets = spark, name, 1
        self.levels: list[tuple[int, str]] = []
        self.made = 0
        self.seeds = scratch_path(spark, "seeds")

    def _save(self, rows: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_level{self.made}"
        rows.write.bucketBy(self.buckets, "bucket").option("compression", "zstd").saveAsTable(table)
        return table

    def add(self, questions: DataFrame) -> list[DataFrame]:
        """Insert a batch's arrays (rows of _QUESTION); written answers 'seed' for all shards concerned."""

        def sort_batch(key: tuple, table: pa.Table) -> pa.Table:
            columns = [_columns(b, 4) for b in table.column("body").to_pylist()]
            shards = np.repeat(np.array(table.column("shard").to_pylist(), np.uint32), [c.shape[1] for c in columns])
            whole = np.concatenate(columns, axis=1)
            return _level_row(key[0].as_py(), whole[:3], shards, whole[3])

        def within(table: pa.Table) -> pa.Table:
            return _seeds(_level_arrays(table))

        def scan(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
            fresh = _level_arrays(new)
            return _seeds(_both(fresh, _level_arrays(old)), len(fresh[1]))

        def merge(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
            return _level_row(key[0].as_py(), *_both(_level_arrays(new), _level_arrays(old)))

        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, new), (_, old) = self.levels.pop(), self.levels.pop()
            joined = self.spark.table(new).groupBy("bucket").cogroup(self.spark.table(old).groupBy("bucket"))
            self.levels.append((2 * size, self._save(joined.applyInArrow(merge, LEVEL))))
            self.drop(new, old)
        batch = self._save(questions.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(sort_batch, LEVEL))
        new = self.spark.table(batch).groupBy("bucket")
        if not self.levels:
            found = [new.applyInArrow(within, ANSWER)]
        else:
            found = [new.cogroup(self.spark.table(t).groupBy("bucket")).applyInArrow(scan, ANSWER) for _, t in self.levels]
        out = [written(f, "seeds", f"{self.seeds}/{self.made}_{i}") for i, f in enumerate(found)]
        self.levels.append((1, batch))
        return out

    def drop(self, *tables: str) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    def clear(self) -> None:
        self.drop(*(t for _, t in self.levels))
        self.levels.clear()

    def drop_seeds(self) -> None:
        drop_path(self.spark, self.seeds)


def _least_answers(kinds: dict[str, Callable]) -> Callable:
    """Answer the questions of one (kind, bucket)."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return kinds[key[0].as_py()](table.column("shard").to_pylist(), table.column("body").to_pylist())

    return answer


def _least_owner(kind: str) -> Callable:
    """For each shard, the keys that it has under a larger id than the smallest anywhere, with the smallest and its confirming hash.

    A shard that has its keys under several ids asks as -1 - shard.
    """

    def of(shards: list[int], bodies: list[bytes]) -> pa.Table:
        columns = [_columns(b, 3) for b in bodies]
        keys, ids, confirm = _first_owners(*(np.concatenate([c[i] for c in columns]) for i in range(3)))
        rows = []
        for shard, (own, least, _) in zip(shards, columns):
            place = np.searchsorted(keys, own)
            less = (ids[place].view(np.int64) < least.view(np.int64)) | (shard < 0)
            if less.any():
                rows.append((max(shard, -1 - shard), kind, np.concatenate([own[less], ids[place][less], confirm[place][less]]).tobytes()))
        return _table(rows, _ANSWER)

    return of


def _first_owners(keys: np.ndarray, ids: np.ndarray, confirm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the least id of each and that id's confirming hash."""
    order = np.lexsort((ids.view(np.int64), keys))
    keys, ids, confirm = keys[order], ids[order], confirm[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], ids[first], confirm[first]


def _several_contexts(shards: list[int], bodies: list[bytes]) -> pa.Table:
    """For each shard, its keys that have more than one context anywhere."""
    columns = [_columns(b, 3) for b in bodies]
    low = [np.concatenate([c[i] for c in columns]) for i in range(3)]
    keys, least, most = _least(low[0], low[1], ~low[2])
    several = keys[least != ~most]
    rows = []
    for shard, c in zip(shards, columns):
        own = c[0][_among(c[0], several)]
        if len(own):
            rows.append((shard, "several", own.tobytes()))
    return _table(rows, _ANSWER)


def sharded(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """doc_id, text, shard: each partition cut where about ``shard_bytes`` are full; a longer text is a shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, base = 0, TaskContext.get().partitionId() << 8
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            ends = seen + np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            # Beyond 256 shards a partition would take numbers of the next one.
            shard = base + np.minimum(np.maximum(ends - 1, 0) // shard_bytes, 255)
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(shard, pa.int32())], names=["doc_id", "text", "shard"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, text string, shard int")


def repeated_spans(
    docs: DataFrame, *, length: int = LENGTH, batches: int | None = None, shard_bytes: int = SHARD_BYTES, bits: int = 64
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start and end).

    ``batches`` follows from the number of shards; fewer ``bits`` of the
    first hash make collisions, for tests.
    """
    spark = docs.sparkSession
    name = f"suffix_{uuid.uuid4().hex}"
    index = LogIndex(spark, name)
    try:
        with shuffles_dropped(spark):
            return _repeated(docs, index, f"{name}_texts", length, batches, shard_bytes, bits)
    finally:
        index.clear()
        index.drop_seeds()
        index.drop(f"{name}_texts")


def _repeated(docs: DataFrame, index: LogIndex, table: str, length: int, batches: int | None, shard_bytes: int, bits: int) -> DataFrame:
    spark, gram = docs.sparkSession, GRAM
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded(docs, shard_bytes).write.bucketBy(max(wide, 2 * docs.rdd.getNumPartitions()), "shard").option("compression", "zstd").saveAsTable(table)
    texts = spark.table(table)
    shards = max(1, texts.select("shard").distinct().count())
    batches = min(shards, batches or max(4, -(-shards // BATCH_SHARDS)))
    buckets = index.buckets = max(wide, shards)  # tasks grow in number with the data, not in size

    def read(table: pa.Table) -> tuple[np.ndarray, list[bytes], Runs]:
        """Ids, bytes and runs of a shard."""
        ids, data = zip(*_texts(table))
        return np.array(ids, np.int64), list(data), Runs(list(data), length, gram, bits)

    def arrays(key: tuple, table: pa.Table) -> pa.Table:
        """The suffixes at a shard's distinct anchors: keys to split them, then prefixes and places."""
        _, data, r = read(table)
        keys, one = _least(r.key, np.arange(len(r.key)))
        at = _joined(data, r.doc[one], r.anchor[one])
        words = _prefixes(np.frombuffer(b"".join(data), np.uint8), at)
        return _table(_asked("array", key[0].as_py(), buckets, keys, *words, at.astype(np.uint64), keep_keys=False), _QUESTION)

    def bounds(kind: str, shard: int, keys: np.ndarray, ids: np.ndarray, confirm: np.ndarray) -> list[tuple]:
        """Questions for the smallest id of each key, with the shard's own; apart for keys of several ids."""
        distinct, least, confirmed = _first_owners(keys, ids.view(np.uint64), confirm)
        one = least.view(np.int64) == -1 - _least(keys, -1 - ids)[1]
        return _asked(kind, shard, buckets, distinct[one], least[one], confirmed[one]) + _asked(
            kind, -1 - shard, buckets, distinct[~one], least[~one], confirmed[~one])

    def contexts(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, data, r = read(table)
        distinct, least, most = _least(r.key, ids[r.doc], -1 - ids[r.doc])
        shared = distinct[least != -1 - most]  # by several ids of this shard
        seeds = _cut(_of_kind(answers, "seed", 1)[0], bits)
        wanted = np.flatnonzero(_among(r.key, _distinct(np.concatenate([shared, seeds]))))
        keys, own = r.key[wanted], r.context[wanted]
        confirm = _confirming(data, r.doc[wanted], r.first[wanted], r.last[wanted] + length)
        low = _least(keys, own, ~own)
        shard = key[0].as_py()
        return _table(bounds("owner", shard, own, ids[r.doc[wanted]], confirm) + _asked("several", shard, buckets, low[0], low[1], ~low[2]), _QUESTION)

    def confirmed(data: list[bytes], hashes: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which stretches a smaller id holds, by both hashes."""
        at = _places(hashes, known[0])
        maybe = np.flatnonzero((at >= 0) & (known[1].view(np.int64)[at] < ids[docs])) if len(known[0]) else np.empty(0, np.int64)
        out = np.zeros(len(hashes), bool)
        out[maybe] = _confirming(data, docs[maybe], first[maybe], last[maybe] + length) == known[2][at[maybe]]
        return out

    def judged(table: pa.Table, answers: pa.Table):
        """Ids, bytes, runs, which runs are repeated whole, and (documents, starts) that must be asked window by window."""
        ids, data, r = read(table)
        whole = confirmed(data, r.context, r.doc, r.first, r.last, ids, _of_kind(answers, "owner", 3))
        ask = np.flatnonzero(~whole & _among(r.key, _of_kind(answers, "several", 1)[0]))
        sizes = r.last[ask] - r.first[ask] + 1
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        docs, starts = np.repeat(r.doc[ask], sizes), np.repeat(r.first[ask], sizes) + within
        return ids, data, r, whole, docs, starts, window_hashes(b"".join(data), _joined(data, docs, starts), length, bits)

    def windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, data, _, _, docs, starts, hashes = judged(table, answers)
        return _table(bounds("window", key[0].as_py(), hashes, ids[docs], _confirming(data, docs, starts, starts + length)), _QUESTION)

    def removed(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, data, r, whole, docs, starts, hashes = judged(table, answers)
        hit = confirmed(data, hashes, docs, starts, starts, ids, _of_kind(answers, "window", 3))
        runs_at, windows_at = (np.searchsorted(x, np.arange(len(data) + 1)) for x in (r.doc, docs))
        out = []
        for j, text in enumerate(data):
            own, single = slice(runs_at[j], runs_at[j + 1]), slice(windows_at[j], windows_at[j + 1])
            begins = np.concatenate([r.first[own][whole[own]], starts[single][hit[single]]])
            ends = np.concatenate([r.last[own][whole[own]], starts[single][hit[single]]]) + length
            spans: list[tuple[int, int]] = []
            if len(begins):
                order = np.argsort(begins)
                begins, ends = begins[order], np.maximum.accumulate(ends[order])
                gaps = np.flatnonzero(begins[1:] > ends[:-1])
                spans = list(zip(begins[np.append(0, gaps + 1)].tolist(), ends[np.append(gaps, -1)].tolist()))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            doc = None if ids[j] == LAST else int(ids[j])
            out.append((doc, len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        return _table(out, _RESULT)

    questions = "kind string, bucket int, shard int, body binary"
    seeds = []
    for b in range(batches):
        part = texts.where(F.pmod(F.xxhash64("shard"), F.lit(batches)) == b)
        seeds += index.add(part.groupBy("shard").applyInArrow(arrays, questions))
    index.clear()

    def joined(answers: list[DataFrame]):
        whole = answers[0]
        for a in answers[1:]:
            whole = whole.union(a)
        return texts.groupBy("shard").cogroup(whole.groupBy("shard"))

    asked = joined(seeds).applyInArrow(contexts, questions)
    kinds = _least_answers({"owner": _least_owner("owner"), "several": _several_contexts})
    first = written(asked.repartition(buckets, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(kinds, ANSWER), "answers")
    index.drop_seeds()
    asked = joined([first]).applyInArrow(windows, questions)
    second = written(asked.repartition(buckets, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_least_answers({"window": _least_owner("window")}), ANSWER), "answers")
    return written(joined([first, second]).applyInArrow(removed, RESULT), "removed")


RESULT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "removed array<struct<start:long,end:long>>"
)
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
