r"""Document fingerprints by consistent weighted sampling.

A text's terms are its five-word shingles (words lower-cased in A-Z; a
shorter text is one term), each weighted by how often it occurs.  For every
sample, gamma variates r and c and a uniform b, drawn from a hash of the
term, give t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the
sample is the (term, t) of the least a.  Two texts agree on a sample with
probability equal to their generalised Jaccard similarity.  The variates are
exact inverses of 40 to 48 random bits each.  The first 16 or 8 bits of each
choose among intervals, which bound ln a from below by tables; the variates
are worked out for every term whose bound doesn't exceed the least value
found, so that the least one is exact.  16 bits of each sample are kept.

A greater weight never makes ln a greater, so the least of a text is that of
its parts, each occurrence taken with weight 1, and of its repeated terms with
their weights.  An edited text takes the parts that it shares with the two
texts it is made of as they are; only shingles at its seams are its own.

``fingerprints`` also compares each document with the next one in descending
order of id (after the last: the first) and with its own edited text, whose
last half comes from the next document.  Rows are range-partitioned by id
once and streamed in order; the one pair per partition that straddles its
edge is completed from a small table of edges.

Defined results: a null text is empty; texts without words have an empty
fingerprint, alike (1.0) with another empty one and unlike (0.0) any other;
null ids come last; rows of equal id are ordered by text; a table of one row
is its own next; an empty table gives an empty table.  Only id and text are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import written
from factweave.llm.shingles import hashes_of, mixed, odd_factors, shingle_hashes, word_hashes

#: The upper 16 bits of a draw choose c's interval among as many of equal share; the lower 16 bits choose r's and b's among 256 each.
C_LEVELS, R_LEVELS, B_LEVELS = 1 << 16, 1 << 8, 1 << 8
BLOCK = 1024
#: Terms whose bounds are held at once; texts, and bytes of texts, that share the calls on them.
ROUND, GROUP, GROUP_BYTES = 16 * BLOCK, 32, 1 << 20
#: More than what 32-bit sums of the bounds can be off by.
MARGIN = 1e-4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_tables: list[np.ndarray] = []


def gamma_quantile(share: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) below which ``share`` (0 <= share < 1) lies."""
    m = -np.log1p(-share)
    x = np.sqrt(2 * m) + m * (2 / 3)
    near_zero = share < 1e-6
    some = near_zero.any()
    if some:
        x[near_zero] = 1.0
    for _ in range(5):  # Newton on x - ln(1 + x) = m
        x += (np.log1p(x) - x + m) * (1 + x) / x
    if some:
        s = np.sqrt(2 * share[near_zero])
        x[near_zero] = s + s * s / 3 + s**3 * (11 / 72)
    return x


def bounds() -> list[np.ndarray]:
    """Least ln c by the upper half of a draw; greatest r (1 - b) and r by the lower half, the last interval of r aside."""
    if not _tables:
        with np.errstate(divide="ignore"):
            ln_c = np.log(gamma_quantile(np.arange(C_LEVELS) / C_LEVELS)) - MARGIN
        r = np.repeat(gamma_quantile(np.minimum(np.arange(1, R_LEVELS + 1), R_LEVELS - 0.5) / R_LEVELS), B_LEVELS)
        b = np.tile(np.arange(B_LEVELS) / B_LEVELS, R_LEVELS)
        _tables.extend(x.astype(np.float32) for x in (ln_c, r * (1 - b), r))
    return _tables


class Sampler:
    """Signatures of weighted terms: ``samples`` values of 16 bits."""

    def __init__(self, samples: int = 64, seed: int = 3):
        self.samples = samples
        self.factors = (odd_factors(samples, seed)[:, None] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.fine = odd_factors(samples, seed + 1)
        self.rows = np.arange(samples)

    def _draws(self, terms: np.ndarray) -> np.ndarray:
        z = (terms >> np.uint64(32)).astype(np.uint32) * self.factors
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x2C1B3C6D)
        z ^= z >> np.uint32(12)
        return z

    def exact(self, sample: np.ndarray, terms: np.ndarray, draws: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t of each term in one sample each."""
        more = mixed(terms * self.fine[sample])
        last = mixed(more + GOLDEN)
        share = np.empty((2, len(more)))
        share[0] = ((draws >> np.uint32(16)) + ((more >> np.uint64(32)) + 0.5) / 2**32) / C_LEVELS
        share[1] = ((draws >> np.uint32(8) & np.uint32(0xFF)) + ((more & np.uint64(0xFFFFFFFF)) + 0.5) / 2**32) / R_LEVELS
        c, r = gamma_quantile(share)
        b = ((draws & np.uint32(0xFF)) + (last >> np.uint64(20)) / 2**44) / B_LEVELS
        t = np.floor(ln_w / r + b)
        return np.log(c) - r * (t - b + 1), t

    def signature(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """``terms``: distinct uint64; ``weights``: positive."""
        if not len(terms):
            return np.empty(0, np.uint16)
        ln_c, r_rest, r = bounds()
        best = np.full(self.samples, np.inf)
        chosen = np.zeros(self.samples, np.uint64)

        def try_terms(sample: np.ndarray, at: np.ndarray, alone: bool) -> None:
            """Samples come in order; ``alone``: each has one term."""
            value, t = self.exact(sample, x[at], z[sample, at], ln_w[at])
            order = np.flatnonzero(value < best[sample])
            if not alone and len(order):
                order = order[np.lexsort((value[order], sample[order]))]
                own = sample[order]
                first = np.ones(len(order), bool)
                np.not_equal(own[1:], own[:-1], out=first[1:])
                order = order[first]  # the least of each sample
            best[sample[order]] = value[order]
            chosen[sample[order]] = x[at[order]] + t[order].astype(np.int64).astype(np.uint64) * GOLDEN

        once = weights == 1
        for single, own in ((True, once), (False, ~once)):
            own_terms, own_weights = (terms, weights) if own.all() else (terms[own], weights[own])
            for start in range(0, len(own_terms), BLOCK):
                x = own_terms[start : start + BLOCK]
                ln_w = np.log(own_weights[start : start + BLOCK])
                z = self._draws(x)
                least = ln_c.take(z >> np.uint32(16), mode="clip")
                low = z & np.uint32(0xFFFF)
                if single:  # ln w = 0, so t = 0
                    least -= r_rest.take(low, mode="clip")
                else:  # r (t - b + 1) is at most ln w + r
                    least -= r.take(low, mode="clip") + ln_w.astype(np.float32)
                lowest = least.argmin(axis=1)
                try_terms(self.rows, lowest, True)
                # Nothing bounds r in its last interval, so terms there are all tried.
                left = (least <= best[:, None].astype(np.float32)) | (low >= np.uint32(0xFF00))
                left[self.rows, lowest] = False
                at = np.flatnonzero(left)
                if len(at):
                    try_terms(*np.divmod(at, len(x)), False)
        return (mixed(chosen) >> np.uint64(48)).astype(np.uint16)

    def least(self, terms: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[ranges, samples]: least ln a and its sample of each range of terms, every one with weight 1.

        Range i is from edges[i] to edges[i + 1] and not empty; the first edge is 0, the last the number of terms.
        """
        best, chosen = np.empty((len(edges) - 1, self.samples)), np.empty((len(edges) - 1, self.samples), np.uint64)
        first = 0
        while first < len(best):
            stop = max(first + 1, int(np.searchsorted(edges, edges[first] + ROUND, side="right")) - 1)
            self._round(terms, edges[first : stop + 1], best[first:stop], chosen[first:stop])
            first = stop
        return best, chosen

    def _round(self, terms: np.ndarray, edges: np.ndarray, best: np.ndarray, chosen: np.ndarray) -> None:
        ln_c, r_rest, _ = bounds()
        blocks, first = [], 0
        while first < len(best):
            stop = max(first + 1, int(np.searchsorted(edges, edges[first] + BLOCK, side="right")) - 1)
            x, own = terms[edges[first] : edges[stop]], edges[first : stop + 1] - edges[first]
            z = self._draws(x)
            least = ln_c.take(z >> np.uint32(16), mode="clip")
            low = z & np.uint32(0xFFFF)
            least -= r_rest.take(low, mode="clip")
            lowest = np.array([least[:, a:b].argmin(axis=1) + a for a, b in zip(own[:-1], own[1:])])
            least[low >= np.uint32(0xFF00)] = -np.inf  # nothing bounds r in its last interval
            least[self.rows, lowest] = np.inf
            blocks.append((slice(first, stop), x, z, least, own, lowest))
            first = stop
        lowest_terms = np.concatenate([x[lowest] for _, x, _, _, _, lowest in blocks])
        draws = np.concatenate([z[self.rows, lowest] for _, _, z, _, _, lowest in blocks])
        value, _ = self.exact(np.tile(self.rows, len(best)), lowest_terms.ravel(), draws.ravel(), np.zeros(draws.size))
        best[:], chosen[:] = value.reshape(best.shape), lowest_terms
        left = []
        for ranges, x, z, least, own, _ in blocks:
            sizes = np.diff(own)
            at = np.flatnonzero(least <= np.repeat(best[ranges].T.astype(np.float32), sizes, axis=1))
            sample, place = np.divmod(at, len(x))
            target = np.repeat(np.arange(ranges.start, ranges.stop), sizes)[place]
            left.append((target * self.samples + sample, sample, x[place], z.ravel()[at]))
        cell, sample, x, draws = map(np.concatenate, zip(*left))
        if len(cell):
            value, _ = self.exact(sample, x, draws, np.zeros(len(cell)))
            _keep_least(best, chosen, cell, value, x)

    def improve(self, best: np.ndarray, chosen: np.ndarray, target: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Take terms with their weights into the rows ``target`` of ``best`` and ``chosen``."""
        ln_c, r_rest, r = bounds()
        for start in range(0, len(terms), BLOCK):
            own = slice(start, start + BLOCK)
            x, row, ln_w = terms[own], target[own], np.log(weights[own])
            z = self._draws(x)
            low = z & np.uint32(0xFFFF)
            rest = r_rest.take(low, mode="clip")
            heavy = np.flatnonzero(ln_w)
            if len(heavy):  # r (t - b + 1) is at most ln w + r
                rest[:, heavy] = r.take(low[:, heavy], mode="clip") + ln_w[heavy].astype(np.float32)
            least = ln_c.take(z >> np.uint32(16), mode="clip") - rest
            at = np.flatnonzero((least <= best.T.astype(np.float32)[:, row]) | (low >= np.uint32(0xFF00)))
            if len(at):
                sample, place = np.divmod(at, len(x))
                value, t = self.exact(sample, x[place], z.ravel()[at], ln_w[place])
                _keep_least(best, chosen, row[place] * self.samples + sample, value, x[place] + t.astype(np.int64).astype(np.uint64) * GOLDEN)

    def of_text(self, text: str, width: int = 5) -> np.ndarray:
        return self.signature(*np.unique(shingle_hashes(word_hashes(text), width), return_counts=True))


def _keep_least(best: np.ndarray, chosen: np.ndarray, cell: np.ndarray, value: np.ndarray, sample: np.ndarray) -> None:
    """Put the least value of each cell, and its sample, where it is less than the one there."""
    less = np.flatnonzero(value < best.ravel()[cell])
    if len(less):
        less = less[np.lexsort((value[less], cell[less]))]
        own = cell[less]
        first = np.ones(len(less), bool)
        np.not_equal(own[1:], own[:-1], out=first[1:])
        less, own = less[first], own[first]
        best.reshape(-1)[own], chosen.reshape(-1)[own] = value[less], sample[less]


WIDTH = 5


class _Text:
    """A text's words and shingles; how many shingles lie in the half that its edited text keeps."""

    def __init__(self, text: str):
        self.text, self.words = text, word_hashes(text)
        self.shingles = shingle_hashes(self.words, WIDTH)
        head = text[: len(text) - len(text) // 2].encode("utf-8", "surrogatepass").lower()
        pieces = head.split()
        #: A last word without white space behind it may go on.
        self.open = pieces[-1:] if not head[-1:].isspace() else []
        self.kept = len(pieces) - len(self.open)
        self.shared = max(0, self.kept - WIDTH + 1)


class _Edited:
    """Shingles of the edited text of ``a``, which ``b`` follows, and which of them neither's parts give."""

    def __init__(self, a: _Text, b: _Text):
        tail = b.text[: len(a.text) // 2].encode("utf-8", "surrogatepass").lower()
        pieces = tail.split()
        end = max(len(pieces) - (not tail[-1:].isspace()), 1)  # words of b from the second to here are whole
        seam = a.open + pieces[:1]
        if a.open and pieces and not tail[:1].isspace():
            seam = [b"".join(seam)]
        whole = b.words[1:end] if len(pieces) > 1 else b.words[:0]
        self.shingles = shingle_hashes(np.concatenate([a.words[: a.kept], hashes_of(seam), whole, hashes_of(pieces[end:])]), WIDTH)
        #: b's shingles from 1 to here are this text's, too, from ``at`` on.
        self.taken = max(1, end - WIDTH + 1) if len(pieces) > 1 else 1
        at = a.kept + len(seam)
        seams = np.ones(len(self.shingles), bool)
        seams[1 : a.shared] = False
        seams[at : at + self.taken - 1] = False
        self.seams = seams


def _own_terms(shingles: np.ndarray, seams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights that no part of another text gives: repeated ones, and those at seams."""
    terms, at, counts = np.unique(shingles, return_index=True, return_counts=True)
    own = (counts > 1) | seams[at]
    return terms[own], counts[own]


def signatures(sampler: Sampler, texts: list[_Text], before: tuple | None) -> tuple[list[np.ndarray], list[np.ndarray], tuple]:
    """Signatures of texts that follow each other, and of the edited texts of all but the last; ``before``: the last result's last item."""
    known = [before[0]] if before else []
    edited = [_Edited(a, b) for a, b in zip(known + texts, (known + texts)[1:])]
    taken = [e.taken for e in edited] if known else [1, *(e.taken for e in edited)]
    # Ranges of the shingles behind the first: up to the end of what the edited text keeps, and of what the one before takes.
    arrays, edges, marks, total = [], [0], [], 0
    for text, cut in zip(texts, taken):
        n = len(text.shingles)
        cuts = sorted({min(max(c, 1), n) for c in (cut, text.shared, n)} | {*range(1 + BLOCK, n, BLOCK)}) if n > 1 else []
        cuts = [c for c in cuts if c > 1]
        marks.append((len(edges) - 1, cuts))
        edges += [total + c - 1 for c in cuts]
        total += max(n - 1, 0)
        arrays.append(text.shingles[1:])
    parts = sampler.least(np.concatenate(arrays), np.array(edges))
    rows = len(texts) + len(edited)
    best, chosen = np.full((rows, sampler.samples), np.inf), np.zeros((rows, sampler.samples), np.uint64)

    def part(mark: tuple, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Least of a text's shingles from 1 to ``end``."""
        start, cuts = mark
        own = slice(start, start + sum(c <= end for c in cuts))
        if own.start == own.stop:
            return np.full(sampler.samples, np.inf), np.zeros(sampler.samples, np.uint64)
        at = parts[0][own].argmin(axis=0)
        return parts[0][own][at, sampler.rows], parts[1][own][at, sampler.rows]

    own_terms = []
    halves = [before[1]] if before else []
    for i, (text, mark) in enumerate(zip(texts, marks)):
        best[i], chosen[i] = part(mark, len(text.shingles))
        halves.append(part(mark, text.shared))
        own_terms.append(_own_terms(text.shingles, np.arange(len(text.shingles)) < 1))
    for i, e in enumerate(edited):
        (a, a_chosen), (b, b_chosen) = halves[i], part(marks[i + 1 - len(known)], e.taken)
        best[len(texts) + i], chosen[len(texts) + i] = np.minimum(a, b), np.where(a <= b, a_chosen, b_chosen)
        own_terms.append(_own_terms(e.shingles, e.seams))
    target = np.repeat(np.arange(rows), [len(t) for t, _ in own_terms])
    sampler.improve(best, chosen, target, *(np.concatenate(x) for x in zip(*own_terms)))
    kept = list((mixed(chosen) >> np.uint64(48)).astype(np.uint16))
    for i, shingles in enumerate([t.shingles for t in texts] + [e.shingles for e in edited]):
        if not len(shingles):
            kept[i] = kept[i][:0]
    return kept[: len(texts)], kept[len(texts) :], (texts[-1], halves[-1])


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most GROUP rows and GROUP_BYTES of text; a longer text is alone."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if i > start and (i - start == GROUP or size + n > GROUP_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _result(doc, text: str, own: np.ndarray, following: str, after: np.ndarray, edited: np.ndarray) -> tuple:
    new = edited_text(text, following)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc, len(text), digest, own.tobytes().hex(), edited.tobytes().hex(), likeness(own, edited), likeness(own, after))


def fingerprints(docs: DataFrame, *, samples: int = 64, partitions: int | None = None) -> DataFrame:
    """Per row: RESULT."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edge = pa.schema([("task", pa.int32()), ("edge", pa.string()), ("text", pa.string()), *_ROW])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, task = Sampler(samples), TaskContext.get().partitionId()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), edge)], schema=edge)

        last = before = None
        for batch in batches:
            for group in _groups(batch):
                found = []
                texts = [_Text(value.as_py() or "") for value in group.column(1)]
                owns, edited, before = signatures(sampler, texts, before)
                if last is None:
                    edited.insert(0, None)
                for doc, text, own, new in zip(group.column(0).to_pylist(), texts, owns, edited):
                    if last is None:
                        found.append((task, "first", text.text, doc, *[None] * 6))
                    else:
                        found.append((task, None, None, *_result(*last, text.text, own, new)))
                    last = (doc, text.text, own)
                yield rows(found)
        if last:
            yield rows([(task, "last", last[1], last[0], *[None] * 6)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            found = []
            for doc, text, following in zip(*(batch.column(i).to_pylist() for i in range(3))):
                edited = sampler.of_text(edited_text(text, following))
                found.append(_result(doc, text, sampler.of_text(text), following, sampler.of_text(following), edited))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ROW)], schema=_ROW)

    order = F.col("doc_id").desc_nulls_last()
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions, order)
        .sortWithinPartitions(order, F.col("text").asc_nulls_first())
    )
    done = written(ordered.mapInArrow(stream, f"task int, edge string, text string, {RESULT}"), "fingerprints")
    edges = done.where(F.col("edge").isNotNull())
    # One row per partition: which partition with rows comes after it (the first after the last).
    tasks = edges.where(F.col("edge") == "last").select("task")
    following = tasks.select(
        "task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())).alias("after")
    )
    lasts = edges.where(F.col("edge") == "last").select("task", "doc_id", "text")
    firsts = edges.where(F.col("edge") == "first").select(F.col("task").alias("after"), F.col("text").alias("following"))
    straddling = lasts.join(following, "task").join(firsts, "after").select("doc_id", "text", "following")
    plain = done.where(F.col("edge").isNull()).select(*_ROW.names)
    return plain.union(straddling.mapInArrow(finish, RESULT))
