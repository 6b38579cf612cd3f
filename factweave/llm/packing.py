r"""Best-fit packing by hierarchical residual rounds.

Each task turns its documents into pieces and packs them best-fit, longest
first.  Bins that lack at most ``slack`` tokens are final.  The underfull
ones become items of the next round, in ``fan_in`` times fewer tasks; a task
gets about ``task_items`` items at most, so that the tree has a forest of
roots where underfull bins are too many for one task.  Only numbers travel
(32 bytes a piece); texts are read once and never shuffled.

Token ids are those of ``tokenizers`` as it comes, from a public byte-level
BPE whose file is a parameter.  Splits of its pattern always fall before a
single space and around a single line end between two visible characters, so
the chunks between them are given to the library apart and remembered.  Latin letters are
what the pattern leaves whole, and a few marks behind them what it splits off whole, so the
library's model gets the letters without the passes that split and align.

Defined results: a null text is empty, so its document is id 0 alone; null
ids and repeated rows are packed like others; equal lengths are ordered by
id; an empty table gives an empty table.  Only id and text are read.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import written

#: Chunks in each of the two generations that a Python worker remembers.
CHUNKS_KEPT = 1 << 19
PIECE = np.dtype([("doc", "<i8"), ("none", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = "bin long, size int, members binary"
#: A space or line end that is not between two visible characters.
_ODD_SPACE = re.compile(r"\s[ \n]|[ \n]\s|\A[ \n]|[ \n]\Z")

#: Letters of Latin-1, which every version of Unicode has, and a few marks that end them; an apostrophe may belong to letters.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]{0,3})\Z")

_encoders: dict[str, "_Encoder"] = {}


def _single_spaces(text: str) -> list[str]:
    """The words of a text whose white space is all single spaces and line ends between visible characters, else none; quicker than the pattern, which decides on the rest."""
    words, spaces = text.split(), text.count(" ") + text.count("\n")
    return words if len(words) == spaces + 1 and sum(map(len, words)) + spaces == len(text) else []


class _Memory(dict):
    """Ids of chunks behind ``before``; what a whole generation didn't need is forgotten."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before, self.old = encode, before, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk, self.before)
        self[chunk] = ids
        return ids

    def forget(self) -> None:
        if len(self) > CHUNKS_KEPT:
            self.old = dict(self)
            self.clear()


class _Encoder:
    """Ids of texts, as the bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self._bpe = Tokenizer.from_file(path)
        # Letters' bytes and the space as the vocabulary writes them.
        latin = list(map(chr, range(256)))
        for c in map(chr, range(0xC0, 0x100)):
            for byte, written_as in zip(c.encode(), self._mapped(c), strict=True):
                latin[byte] = written_as
        self._latin = "".join(latin)
        self._space = self._mapped(" a")[0]
        self._model = self._bpe.model
        self._marks = _Memory(lambda marks, before: self.plain(before + marks), "")
        self._line_end = self.plain("\n")
        self._first, self._after = _Memory(self._chunk, ""), _Memory(self._chunk, " ")

    def _mapped(self, letters: str) -> str:
        return self._bpe.pre_tokenizer.pre_tokenize_str(letters)[0][0]

    def plain(self, text: str) -> bytes:
        return array("I", self._bpe.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _chunk(self, chunk: str, before: str) -> bytes:
        m = _LETTERS.match(chunk)
        if not m:
            return self.plain(before + chunk)
        if m.group(2):
            return (self._after if before else self._first)[m.group(1)] + self._marks[m.group(2)]
        letters = codecs.charmap_decode(chunk.encode(), "strict", self._latin)[0]
        return array("I", [t.id for t in self._model.tokenize(self._space + letters if before else letters)]).tobytes()

    def ids(self, text: str) -> bytes:
        self._first.forget()
        self._after.forget()
        words = _single_spaces(text)
        if words:
            chunks = iter(words)
        elif _ODD_SPACE.search(text):
            return self.plain(text)
        else:
            chunks = iter(re.split("[ \n]", text))
        after = self._after.__getitem__
        return self._line_end.join([
            self._first[next(chunks)] + b"".join(map(after, islice(chunks, line.count(" ")))) for line in text.split("\n")
        ])


def encoder(path: str) -> _Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length): whole pieces of ``most`` at the end, what remains first."""
    if total <= most:
        return [(0, total)]
    first = total % most or most
    return [(0, first), *((at, most) for at in range(first, total, most))]


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, taken in the order given; the fullest bin that it fits gets it."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count, out = 0, 0, []
    for size in sizes:
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[free].pop()
            if not open_bins[free]:
                mask ^= 1 << free
        else:
            free, chosen = capacity, count
            count += 1
        left = free - size
        if left:
            open_bins[left].append(chosen)
            mask |= 1 << left
        out.append(chosen)
    return out


def _bins(items: list[tuple[int, tuple, bytes]], capacity: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Pack (size, order, members) and give the bins, in batches."""
    items.sort(key=lambda x: (-x[0], x[1]))
    members: dict[int, list[bytes]] = {}
    sizes: dict[int, int] = {}
    for (size, _, blob), b in zip(items, best_fit([x[0] for x in items], capacity)):
        members.setdefault(b, []).append(blob)
        sizes[b] = sizes.get(b, 0) + size
    base = (turn << 58) | (TaskContext.get().partitionId() << 34)
    order = list(sizes)
    for i in range(0, len(order), 5000):
        part = order[i : i + 5000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([base + b for b in part], pa.int64()), pa.array([sizes[b] for b in part], pa.int32()),
             pa.array([b"".join(members[b]) for b in part], pa.binary())],
            names=["bin", "size", "members"],
        )


def pack(
    docs: DataFrame, *, capacity: int = 2048, slack: int = 4, fan_in: int = 8, task_items: int = 50_000,
    end_id: int = 0, vocabulary: str | None = None,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        items = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    row = np.array([(doc or 0, doc is None, k, start, length, crc)], PIECE)
                    items.append((length, (doc is None, doc or 0, k, crc), row.tobytes()))
        yield from _bins(items, capacity, 0)

    def next_round(turn: int):
        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [
                (size, (b,), members)
                for batch in batches
                for b, size, members in zip(*(batch.column(i).to_pylist() for i in range(3)))
            ]
            yield from _bins(items, capacity, turn)

        return again

    bins = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first_round, BINS), "bins")
    full = F.col("size") >= capacity - slack
    final, rest = bins.where(full), bins.where(~full)
    counts = bins.agg(F.count_if(~full).alias("rest"), F.count("*").alias("all"), F.max((F.col("bin").bitwiseAND((1 << 58) - 1) / F.lit(1 << 34)).cast("int"))).first()
    left, tasks, turn = counts[0], (counts[2] or 0) + 1, 0
    while left and tasks > 1:
        fewer = max(-(-tasks // fan_in), -(-left // task_items))
        if fewer >= tasks:
            break
        turn, tasks = turn + 1, fewer
        bins = written(rest.repartition(tasks, "bin").mapInArrow(next_round(turn), BINS), "bins")
        final, rest = final.union(bins.where(full)), bins.where(~full)
        left = rest.count()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                blobs = [np.frombuffer(m.as_py(), PIECE) for m in part.column(1)]
                if not blobs:
                    continue
                rows = np.concatenate(blobs)
                offsets = np.concatenate([np.cumsum(b["length"], dtype=np.int64) - b["length"] for b in blobs])
                ids = np.repeat(part.column(0).to_numpy(), [len(b) for b in blobs])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc"].astype(np.int64), mask=rows["none"]), pa.array(rows["piece"].astype(np.int32)),
                     pa.array(rows["start"].astype(np.int64)), pa.array(rows["length"].astype(np.int64)),
                     pa.array(rows["crc"].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(offsets)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return final.union(rest).select("bin", "members").mapInArrow(
        spread, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
