r"""Language identification with blended-spectrum string kernels.

The kernel of two texts counts the n-grams (bytes of the lower-cased letters,
n from 1 to ``most``; presence only, however often) that both hold, over the root
of the product of how many each holds; an n-gram is known by a hash of ``bits`` bits,
and only n-grams of some landmark count.  Landmarks are documents of the training rows; the Nyström map is the kernel to the landmarks
times the inverse root of the kernel among them.  Ridge regression, one language
against the rest with rows weighted so that languages count alike, needs the
moments of this map over the training rows only: each task sums them.
Scoring is two matrix products a batch: presence (sparse) by landmarks, and that by weights.

What is bounded, by documented parameters: ``landmarks`` in all, shared evenly by
the languages (one each at least), and the training rows (about ``rows_each``
per language, drawn among all by a seeded hash).  Every text is read
whole, in buffers of bounded size.

Defined results: null texts, and texts without a letter, are ``und`` with score
0 and no training rows, as rows of a null language are not; a language of one row is learned from it; repeated rows are
equal; without training rows everything is ``und``; an empty table gives an
empty table.  A null id counts as an empty string in the hashes.  Only id, text and
lang are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import written

LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = {i: " " for i in range(128) if not chr(i).isalpha()}
BUFFER = 1 << 20
#: N-grams whose rows of landmarks are gathered at a time.
GATHER = 1 << 15


def letters(text: str) -> bytes:
    """Lower-cased text, ASCII that is no letter as single spaces, and a space at both ends."""
    return b" " + b" ".join(text.lower().translate(_NOT_LETTERS).encode("utf-8", "replace").split()) + b" "


def slots(data: bytes, most: int, bits: int) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of 1 to ``most`` (at most 4) bytes, in buffers that overlap (so some come twice)."""
    for at in range(0, len(data), BUFFER):
        raw = np.frombuffer(data, np.uint8)[at : at + BUFFER + most - 1].astype(np.uint64)
        code = raw
        for n in range(1, min(most, len(raw)) + 1):
            if n > 1:
                code = code[:-1] << np.uint64(8) | raw[n - 1 :]
            tagged = (code << np.uint64(3) | np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (tagged >> np.uint64(64 - bits)).astype(np.int64)


def spectrum(text: str, most: int, bits: int) -> np.ndarray:
    """The sorted distinct slots of a whole text."""
    present = np.zeros(1 << bits, bool)
    for found in slots(letters(text), most, bits):
        present[found] = True
    return np.flatnonzero(present)


@dataclass
class KernelModel:
    """Landmarks as a matrix over the n-grams that any of them holds, and the learned weights."""

    most: int
    bits: int
    languages: list[str]
    columns: np.ndarray  # slot -> row of ``presence``, -1 for n-grams of no landmark
    presence: np.ndarray  # n-gram x landmark, 0 or 1, each column over the root of its sum
    weights: np.ndarray | None = None  # landmark x language

    @classmethod
    def of(cls, spectra: list[np.ndarray], languages: list[str], most: int, bits: int) -> KernelModel:
        known = np.unique(np.concatenate(spectra))
        columns = np.full(1 << bits, -1, np.int32)
        columns[known] = np.arange(len(known), dtype=np.int32)
        presence = np.zeros((len(known), len(spectra)), np.float32)
        for i, held in enumerate(spectra):
            presence[columns[held], i] = 1 / np.sqrt(len(held))
        return cls(most, bits, languages, columns, presence)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Texts by landmarks."""
        flags, rows = np.zeros(len(self.presence), bool), []
        for text in texts:
            for found in slots(letters(text), self.most, self.bits):
                at = self.columns[found]
                flags[at[at >= 0]] = True
            held = np.flatnonzero(flags)
            flags[held] = False
            rows.append(held)
        out = np.zeros((len(texts), self.presence.shape[1]), np.float32)
        for i, held in enumerate(rows):
            for at in range(0, len(held), GATHER):
                out[i] += self.presence[held[at : at + GATHER]].sum(axis=0)
            out[i] /= np.sqrt(max(1, len(held)))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _texts(batch: pa.RecordBatch, column: int) -> list[str | None]:
    return batch.column(column).to_pylist()


def training_rows(docs: DataFrame, rows_each: int, seed: int) -> DataFrame:
    """Of each language about ``rows_each`` training rows, those whose seeded hash lies in its share: language, draw, text; written.

    The share is ``rows_each`` over the language's exact number of training
    rows, so a language of no more gives all of them.  One count a language
    reaches the driver, and no text is shuffled but the sample's.  Rows of one id count as one.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40))
    usable = ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()
    rows = docs.where(usable).select(F.col("lang").alias("language"), draw.alias("draw"), F.col("text").cast("string").alias("text"))
    counts = rows.groupBy("language").count().collect()
    if not counts:
        return rows.limit(0)
    shares = [(r["language"], -(-(rows_each << 40) // max(rows_each, r["count"]))) for r in counts]
    cutoffs = F.broadcast(docs.sparkSession.createDataFrame(shares, "language string, cutoff long"))  # a row per language
    return written(rows.join(cutoffs, "language").where(F.col("draw") < F.col("cutoff")).drop("cutoff").dropDuplicates(["language", "draw"]), "training")


def learn(
    docs: DataFrame, *, most: int = 4, bits: int = 20, landmarks: int = 128, rows_each: int = 500, ridge: float = 1e-3, seed: int = 13
) -> KernelModel | None:
    """The model of ``docs`` (doc_id, text, lang), from rows that are not held out; None without any."""
    rows = training_rows(docs, rows_each, seed)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spectrum(t, most, bits).astype(np.int32) for t in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["language", "slots"])

    first = F.row_number().over(Window.partitionBy("language").orderBy("draw"))
    languages = sorted(r[0] for r in rows.select("language").distinct().collect())
    if not languages:
        return None
    each = max(1, landmarks // len(languages))
    chosen = rows.withColumn("place", first).where(F.col("place") <= each).select("language", "text")
    spectra = sorted(chosen.mapInArrow(describe, "language string, slots array<int>").collect())  # ``landmarks`` rows of at most 2^bits numbers
    model = KernelModel.of([np.array(r["slots"], np.int64) for r in spectra], languages, most, bits)
    m, code = len(spectra), {name: i for i, name in enumerate(languages)}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by 2^bits n-grams and ``landmarks`` columns

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            names, kernel = _texts(batch, 0), shared.value.kernel(_texts(batch, 1)).astype(np.float64)
            for name in set(names):
                k = kernel[[i for i, x in enumerate(names) if x == name]]
                n, gram, total = sums.get(name, (0, 0.0, 0.0))
                sums[name] = n + len(k), gram + k.T @ k, total + k.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*sums], pa.string()), pa.array([n for n, _, _ in sums.values()], pa.int64()),
             pa.array([np.concatenate([g.ravel(), t]).tobytes() for _, g, t in sums.values()], pa.binary())],
            names=["language", "n", "moments"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table.column("moments"))
        return pa.table({"language": table.column("language")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "moments": pa.array([total.tobytes()], pa.binary())})

    shape = "language string, n long, moments binary"
    sums = rows.select("language", "text").mapInArrow(moments, shape).groupBy("language").applyInArrow(add, shape).collect()  # a row per language
    gram, toward = np.zeros((m, m)), np.zeros((m, len(languages)))
    for row in sums:
        moment = np.frombuffer(row["moments"])
        gram += moment[: m * m].reshape(m, m) / row["n"]
        toward[:, code[row["language"]]] = moment[m * m :] / row["n"]
    among = model.presence.T.astype(np.float64) @ model.presence
    values, vectors = np.linalg.eigh(among)
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # the Nyström map of a row of the kernel
    mapped = root.T @ gram @ root + ridge * len(languages) * np.eye(int(good.sum()))
    model.weights = (root @ np.linalg.solve(mapped, root.T @ toward)).astype(np.float32)
    shared.unpersist()
    return model


def identify(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    model = learn(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = _texts(batch, 2)
            names, sure = ["und"] * len(texts), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
            if asked:
                scores = model.scores([texts[i] for i in asked])
                for i, best, score in zip(asked, scores.argmax(axis=1), scores.max(axis=1), strict=True):
                    names[i], sure[i] = model.languages[best], min(1.0, max(0.0, float(score)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
