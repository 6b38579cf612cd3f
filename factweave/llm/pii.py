r"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) are fixed grammars and always stay.
Candidates are wide: runs of digits in groups, pairs of capitalised words
(also where pairs overlap), values assigned to secret-like identifiers, and
long tokens of letters and digits.  Five labelers vote on each, or abstain:

- pattern: the strict form (area codes, valid number ranges, known prefixes
  of keys, a title before a name);
- gazetteer: lists of given and family names and of key lengths, and for names
  a gazetteer built from the corpus: words that cues or titles stand before in
  ``CUED`` occurrences or more and a ``CUED_SHARE`` of all, the
  ``GAZETTEER_WORDS`` most frequent;
- context: cues and counter-cues within forty characters before;
- boundary and shape: they only vote against.

The counts of vote patterns over all rows are grouped by Spark; a kind has at
most 3^5 patterns, so the table that reaches the driver is bounded however
large the corpus is.  Expectation-maximisation on it estimates each labeler's
reliability per kind; a candidate that no labeler speaks for counts as
negative.  The posteriors label a sample of at most ``SAMPLE`` candidates a
kind and side, by hash, on which a logistic regression is fitted: votes, and
hashed features of the span (shape, endings, length) and of the words around
it, so that it can tell spans on which all labelers abstain, and turn down
others.

Defined results: a null text counts as empty; offsets are code points, end
exclusive; candidates that touch a base span are dropped, and of accepted ones
that overlap the likeliest stays (of equals the first); repeated rows repeat; without candidates
no classifier is trained and base spans remain.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import written

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "national_id", "name", "secret")
KINDS = BASE + ADDED
LABELERS = ("pattern", "gazetteer", "context", "boundary", "shape")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried at its start only: no later start in it can match where the first fails.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# Shorter runs can't have 14 digits, so they need not be matched to be dropped.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_GROUPS = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,5}){1,3}(?![\w-])")
_LOCAL_PHONE = re.compile(r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}")
_NATIONAL_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_CAPITALS = r"[A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_A-ZÀ-ÖØ-Þ]{1,39}"
_NAME = re.compile(rf"\b(?=({_CAPITALS} {_CAPITALS})\b)")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Monsieur|Madame|Señor|Señora)\.? \Z")
# An identifier is tried at its start only.
_SECRET = re.compile(
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?ai:token|secret|password|passwd|api[_-]?key|access[_-]?key))[A-Za-z0-9_-]++"
    r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{12,})"
)
_LONG = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{18,}={0,2}(?![A-Za-z0-9_+/=-])")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}\Z|gh[pousr]_[A-Za-z0-9]{36}\Z|sk-[A-Za-z0-9_-]{20,}\Z|xox[abps]-|eyJ[A-Za-z0-9_-]{10,}")

#: Frequent given and family names.
FIRST_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa "
    "Daniel Nancy Matthew Betty Anthony Sandra Mark Ashley Donald Emily Steven Kimberly Paul Margaret Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa "
    "George Deborah Timothy Stephanie Ronald Rebecca Edward Laura Jason Helen Jeffrey Sharon Ryan Cynthia Jacob Kathleen Gary Amy Nicholas Angela Eric Anna Jonathan Ruth Peter "
    "Hans Klaus Jürgen Günter Wolfgang Dieter Monika Ursula Sabine Petra Andrea Heike Stefan Uwe Bernd Matthias Katrin Sophie Julia Lukas Felix Jonas Lena Marie Pierre Jean "
    "Michel André Philippe Alain Bernard Jacques François Nathalie Isabelle Sylvie Catherine Martine Camille Chloé Louis Hugo José Juan Antonio Manuel Francisco Carlos Luis "
    "Javier Miguel Pedro María Carmen Ana Isabel Dolores Pilar Teresa Lucía Elena Cristina Sofía Wei Li Yan Min Amit Priya Rahul Fatima Omar Ahmed Olga Ivan Natalia".split()
)
LAST_NAMES = frozenset(
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson "
    "White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell "
    "Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun "
    "Krüger Hofmann Hartmann Lange Werner Bernard Dubois Robert Petit Durand Leroy Moreau Simon Laurent Lefebvre Michel Bertrand Roux Vincent Fournier Morel Girard Fernández "
    "González Rodríguez López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Wang "
    "Zhang Chen Liu Kumar Singh Patel Khan Ali Ivanov Petrov".split()
)
CUES = {
    "local_phone": "call phone tel telephone mobile fax number dial ring text",
    "national_id": "ssn social security national id identity taxpayer",
    "name": "mr mrs ms dr prof name named contact dear sincerely signed regards attn patient customer mother father",
    "secret": "token secret password passwd key credential credentials auth bearer apikey",
}
COUNTER_CUES = {
    "local_phone": "version isbn section order invoice page figure table dated",
    "national_id": "version part serial model order isbn dated",
    "name": "street avenue license city university mount lake river new north south east west hotel the of and in on",
    "secret": "checksum sha1 sha256 md5 commit digest revision hash build",
}
_CUE_WORDS = {k: (frozenset(CUES[k].split()), frozenset(COUNTER_CUES[k].split())) for k in ADDED}
_PLACES = frozenset("Street Avenue Road City University Lake River Hotel Park Island County Bank Company House School License".split())
CONTEXT_CHARS = 40
#: The corpus gazetteer of names: cued occurrences, their share of all, and words at most.
CUED, CUED_SHARE, GAZETTEER_WORDS = 3, 0.3, 20_000
#: Candidates at most, by kind and by whether a labeler speaks for them, that the classifier is fitted to.
SAMPLE = 5_000
FEATURES = 1 << 12


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each starts where the run before its @ does, or where the last match ended."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            out.append((start, last))
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed grammars, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_TOKEN = re.compile(r"[^\W_]+")


def _shape(span: str) -> str:
    """Runs of capitals, letters and digits as one sign each."""
    signs = ["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in span[:48]]
    return "".join(c for i, c in enumerate(signs) if not i or c != signs[i - 1])


def _features(kind: int, text: str, start: int, end: int, near: list[str]) -> list[int]:
    """Hashed features of a span and the words around it."""
    span = text[start:end]
    behind = _TOKEN.search(text, end, end + CONTEXT_CHARS)
    told = [f"shape {_shape(span)}", f"length {min(12, len(span) // 4)}", f"after {behind.group().lower() if behind else ''}", f"near {text[start - 1 : start]}{text[end : end + 1]}"]
    told += [f"before {near[-1] if near else ''}", f"two {' '.join(near[-2:])}"]
    if kind == 6:
        first, second = span.split(" ")
        told += [f"first {first}", f"second {second}", f"end {first[-2:]} {second[-2:]}", f"same {first == second}", f"end {second[-2:]}"]
    else:
        told.append(f"begin {span[:3]}")
    return [zlib.crc32(f"{kind} {t}".encode()) % FEATURES for t in told]


def _votes(kind: int, text: str, start: int, end: int, assigned: bool, near: list[str]) -> str:
    """A sign a labeler: +, - or 0."""
    name, span = KINDS[kind], text[start:end]
    cues, counter = _CUE_WORDS[name]
    digits = sum(c.isdigit() for c in span)
    listed = 0
    if name == "local_phone":
        pattern = 1 if _LOCAL_PHONE.fullmatch(span) else -1 if _ISO_DAY.fullmatch(span) or not 7 <= digits <= 11 else 0
        listed, shape = int(digits == 10 and span[-8:-5] == "555"), len(set(span)) > 4
    elif name == "national_id":
        valid = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
        pattern, shape = 1 if valid else -1, len(set(span)) > 3
    elif name == "name":
        first, second = span.split(" ")
        pattern = int(bool(_TITLE.search(text, max(0, start - 10), start)))
        listed = 1 if first in FIRST_NAMES else -1 if second in _PLACES else int(second in LAST_NAMES)
        shape = len(second) > 2 and first.lower() not in counter
    else:
        pattern = 1 if assigned or _KEY.match(span) else -1 if _DIGEST.fullmatch(span) else 0
        listed = int(len(span) in (20, 32, 36, 40, 64))
        shape = 10 * digits >= len(span) and digits < len(span)
    close = near[-2:] if name == "name" else near
    context = 1 if cues.intersection(close) else -1 if counter.intersection(close) else 0
    inside = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return "".join("-0+"[v + 1] for v in (pattern, listed, context, -1 if inside else 0, 0 if shape else -1))


_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})")
_ISO_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[int]]]:
    """(start, kind, end, votes, features) that overlap none of ``taken``, leftmost first; they may overlap each other."""
    found: dict[tuple[int, int, int], bool] = {}
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            found[m.start(), 5 if _NATIONAL_ID.fullmatch(m.group()) else 4, m.end()] = False
        if "=" in text or ":" in text:
            found |= {(m.start(1), 7, m.end(1)): True for m in _SECRET.finditer(text)}
        for m in _LONG.finditer(text):
            found.setdefault((m.start(), 7, m.end()), False)
    for m in _NAME.finditer(text):
        first, second = m.group(1).split(" ")
        if first != second and first.lower() not in _CUE_WORDS["name"][0]:
            found[m.start(1), 6, m.end(1)] = False
    out, i = [], 0
    bounds = sorted((a, b) for a, _, b in taken)
    for (start, kind, end), assigned in sorted(found.items()):
        while i < len(bounds) and bounds[i][1] <= start:
            i += 1
        if i < len(bounds) and bounds[i][0] < end:
            continue
        near = [w.lower() for w in _TOKEN.findall(text, max(0, start - CONTEXT_CHARS), start)]
        out.append((start, kind, end, _votes(kind, text, start, end, assigned, near), _features(kind, text, start, end, near)))
    return out


def final_votes(kind: int, votes: str, span: str, gazetteer: frozenset[str]) -> str:
    """The votes with the corpus gazetteer's, where the lists abstain on a name; it must hold both words."""
    if kind == 6 and votes[1] == "0" and gazetteer.issuperset(span.split(" ")):
        return f"{votes[0]}+{votes[2:]}"
    return votes


def spoken(votes: str) -> bool:
    return "+" in votes


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _vote_places(kind: int, votes: str) -> list[int]:
    """Features of votes, behind the hashed ones."""
    base = FEATURES + (kind - len(BASE)) * (3 * len(LABELERS) + 1)
    return [base, *(base + 1 + 3 * j + "-0+".index(c) for j, c in enumerate(votes))]


PLACES = FEATURES + len(ADDED) * (3 * len(LABELERS) + 1)


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers, weights of the classifier, and the corpus gazetteer."""

    reliability: dict[str, dict[str, float]]
    weights: np.ndarray
    gazetteer: frozenset[str]

    def probability(self, kind: int, votes: str, features: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(self.weights[features + _vote_places(kind, votes)].sum())))))

    def chosen(self, text: str, found: list[tuple[int, int, int, str, list[int]]], least: float = 0.5) -> list[tuple[int, int, int]]:
        """(start, kind, end) of accepted candidates; of those that overlap the likeliest, of equals the first."""
        if not self.reliability:
            return []
        judged = []
        for start, kind, end, votes, features in found:
            votes = final_votes(kind, votes, text[start:end], self.gazetteer)
            judged.append((-self.probability(kind, votes, features), start, kind, end))
        out: list[tuple[int, int, int]] = []
        for p, start, kind, end in sorted(judged):
            if -p < least:
                break
            at = bisect(out, (start, kind, end))
            if (not at or out[at - 1][2] <= start) and (at == len(out) or end <= out[at][0]):
                out.insert(at, (start, kind, end))
        return out


def _em(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors, and P(vote for | class, voted) as [class, labeler], by MAP-EM with a prior that labelers beat chance.

    To abstain tells nothing.  To begin with, a vote against weighs as two for.
    """
    cast, for_it = (votes != 0).astype(float), (votes > 0).astype(float)
    prior_for, prior_all = np.array([[1.0], [4.0]]), 5.0
    post = 1 / (1 + np.exp(-2.0 * (for_it.sum(axis=1) - 2 * (cast - for_it).sum(axis=1))))
    theta = np.zeros((2, votes.shape[1]))
    for _ in range(rounds):
        both = np.stack([1 - post, post]) * weight
        theta = (both @ for_it + prior_for) / (both @ cast + prior_all)
        share = (both.sum(axis=1) + 1) / (weight.sum() + 2)
        logs = np.log(share)[:, None] + np.log(theta) @ for_it.T + np.log1p(-theta) @ (cast - for_it).T
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return post, theta


def posteriors(counts: list[tuple[int, str, int]]) -> tuple[dict[str, dict[str, float]], dict[tuple[int, str], float]]:
    """EM per kind on (kind, votes, count): reliability of each labeler, and P(personal) of each (kind, votes).

    Candidates that nobody speaks for are negatives and take no part in EM.
    """
    reliability, label = {}, {(k, votes): 0.0 for k, votes, _ in counts}
    for kind in sorted({k for k, _, _ in counts}):
        own = [(votes, n) for k, votes, n in sorted(counts) if k == kind and spoken(votes)]
        if not own:
            continue
        signs = np.array([["-0+".index(c) - 1 for c in votes] for votes, _ in own])
        post, theta = _em(signs, np.array([n for _, n in own], float))
        reliability[KINDS[kind]] = {x: float(theta[1, j] / (theta[1, j] + theta[0, j])) for j, x in enumerate(LABELERS)}
        label |= {(kind, votes): float(p) for (votes, _), p in zip(own, post)}
    return reliability, label


def fit(rows: list[tuple[int, str, list[int]]], label: dict[tuple[int, str], float], rounds: int = 150) -> np.ndarray:
    """Weights of a logistic regression on votes and hashed features against the posteriors."""
    weights = np.zeros(PLACES)
    if not rows:
        return weights
    places = [np.array(features + _vote_places(kind, votes)) for kind, votes, features in rows]
    owner, place = np.repeat(np.arange(len(rows)), [len(p) for p in places]), np.concatenate(places)
    want = np.array([label[kind, votes] for kind, votes, _ in rows])
    squares = np.full(PLACES, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[place], len(rows)), -50, 50)))
        slope = np.bincount(place, (p - want)[owner], PLACES) + 0.05 * weights
        squares += slope * slope
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


SCAN = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
    "candidates array<struct<start:int,kind:int,end:int,votes:string,span:string,features:array<int>>>"
)
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("span", pa.string()), ("features", pa.list_(pa.int32()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [[], [], [], []]
        digests, bases, others = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            bases.append([dict(zip(("start", "kind", "end"), s)) for s in base])
            others.append([
                {"start": a, "kind": k, "end": b, "votes": votes, "span": text[a:b] if k == 6 else "", "features": features}
                for a, k, b, votes, features in candidates(text, base)
            ])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
             pa.array(bases, pa.list_(_SPAN)), pa.array(others, pa.list_(_CANDIDATE))],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "candidates"],
        )


def scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_scan, SCAN)


def corpus_names(found: DataFrame) -> frozenset[str]:
    """Words of names that titles and cues stand before, from all candidates."""
    cued = F.substring("votes", 1, 1).eqNullSafe("+") | F.substring("votes", 3, 1).eqNullSafe("+")
    words = found.where("kind = 6").select(F.explode(F.split("span", " ")).alias("word"), cued.cast("int").alias("cued"))
    often = words.groupBy("word").agg(F.sum("cued").alias("cued"), F.count("*").alias("n")).where((F.col("cued") >= CUED) & (F.col("cued") >= CUED_SHARE * F.col("n")))
    return frozenset(r["word"] for r in often.orderBy(F.desc("cued"), "word").limit(GAZETTEER_WORDS).collect())


def train(scanned: DataFrame) -> SpanModel:
    """The model of a scanned corpus; texts are not read again."""
    found = scanned.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    gazetteer = corpus_names(found)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [final_votes(*row, gazetteer) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(votes, pa.string()), batch.column(5)], names=["doc_id", "start", "kind", "votes", "features"])

    found = found.select("doc_id", "start", "kind", "votes", "span", "features").mapInArrow(vote, "doc_id long, start int, kind int, votes string, features array<int>")
    counts = [(r["kind"], r["votes"], r["n"]) for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    reliability, label = posteriors(counts)
    sides: dict[tuple[int, bool], int] = {}
    for kind, votes, n in counts:
        sides[kind, spoken(votes)] = sides.get((kind, spoken(votes)), 0) + n
    chance = F.pmod(F.xxhash64("doc_id", "start", "kind", "features"), F.lit(1 << 40))
    taken = F.lit(False)
    for (kind, for_it), n in sorted(sides.items()):
        taken = taken | ((F.col("kind") == kind) & (F.col("votes").contains("+") == for_it) & (chance < int((1 << 40) * min(1.0, SAMPLE / n))))
    rows = sorted((r["kind"], r["votes"], list(r["features"])) for r in found.where(taken).select("kind", "votes", "features").collect())
    return SpanModel(reliability, fit(rows, label), gazetteer)


def find(docs: DataFrame) -> tuple[DataFrame, SpanModel]:
    """Per row: doc_id, counts, base_sha256 and the string of all spans; and the model."""
    scanned = written(scan(docs), "spans")
    model = train(scanned)

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for base, found in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                own = [(c["start"], c["kind"], c["end"], final_votes(c["kind"], c["votes"], c["span"], model.gazetteer), c["features"]) for c in found]
                said.append(joined([*((b["start"], b["kind"], b["end"]) for b in base), *model.chosen("", own)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(said, pa.string())], names=[*batch.schema.names[:6], "spans"])

    return scanned.mapInArrow(say, SCAN[: SCAN.index("base array")] + "spans string"), model


def redact_text(text: str, model: SpanModel) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    base = base_spans(text)
    spans = base + model.chosen(text, candidates(text, base))
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> tuple[DataFrame, SpanModel]:
    """The rows with spans replaced in ``text`` (null stays null), and ``n_chars`` counted anew; and the model.

    Texts are scanned twice, once for candidates and once to replace, so none is shuffled or stored.
    """
    ids = docs.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text"))
    model = train(written(scan(ids).select("doc_id", "candidates").where(F.size("candidates") > 0), "candidates"))
    place = docs.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([None if (t := v.as_py()) is None else redact_text(t, model) for v in batch.column(place)], pa.string())
            columns = [column if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(replace, docs.schema)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns), model
