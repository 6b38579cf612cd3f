"""Importance draw, ranked search and language identification against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import block_max, crc_ring, string_kernel
from factweave.llm.alnum import word_blocks

SCHEMA = "doc_id long, text string, lang string, item_id long, rank string, part int, score string, draw int, language string, shard string, term int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lowered(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcXYÉß9") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [rng.choice([" ", ", ", "\x00", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 19, 20, 21, 150]))) for _ in range(120)]
    texts += [texts[0]] * 40 + [None, "", " \n..!", "x", "É" * 3000, " ".join(rng.choice(vocabulary) for _ in range(30000))]
    out = [(i * 3, t, None, 1, "r", 2, "s", 3, "l", "h", 4) for i, t in enumerate(texts)]
    return out + [out[4], out[4], (None, texts[1], *out[1][2:]), (None, texts[1], *out[1][2:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_blocks():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZ09 \n-_éÉ中\x00\x7f@[`{/:") for _ in range(rng.randint(0, 60)))
        for block in (1, 7, 1 << 16):
            assert [w.decode() for ws in word_blocks(text.encode(), block) for w in ws] == words(text)
    assert list(word_blocks(None)) == []


def test_ring_gives_each_run_once_however_the_words_are_cut():
    rng = random.Random(2)
    for n in (1, 2, 3, 5):
        text = [rng.choice(["a", "bé", "cc"]).encode() for _ in range(40)]
        ring, got, at = crc_ring.CrcRing(n), [], 0
        while at < len(text):
            k = rng.randint(1, 6)
            got += itertools.chain.from_iterable(ring.extend(text[at : at + k]))
            at += k
        assert sorted(got) == sorted(crc32(b" ".join(text[j : j + k])) for k in range(1, n + 1) for j in range(len(text) - k + 1))


def brute_draw(rows, targets):
    def features(text):
        w = words(text)
        return [crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    found = [features(r[1]) for r in rows]
    s, t = Counter(itertools.chain.from_iterable(found)), Counter(b for x in targets for b in features(x))
    whole, aim = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole + 10000) / ((s[b] + 1) * (aim + 10000))))
    out = []
    for row, f in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([row[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(row[1]))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    return sorted(tuple(r[:5]) for r in out if r[0] is not None), sorted(str(r[1:5]) for r in out if r[0] is None)


def test_draw_equals_brute_force(spark, rows, docs):
    targets = [rows[5][1], rows[7][1], None, ""]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    got = crc_ring.importance_draw(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert (sorted((tuple(r) for r in got if r[0] is not None), key=str), sorted(str(list(r[1:])) for r in got if r[0] is None)) == (
        sorted(brute_draw(rows, targets)[0], key=str), brute_draw(rows, targets)[1])
    kept = crc_ring.resample(docs, target)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["rank"]}


def test_draw_of_nothing(spark, docs, none):
    assert crc_ring.importance_draw(none, docs).collect() == []
    empty_target = crc_ring.importance_draw(docs, none).collect()
    assert len(empty_target) == docs.count() and sorted(r["rank"] for r in empty_target if r["rank"]) == list(range(1, sum(r["n_words"] >= 20 for r in empty_target) // 20 + 1))


def test_block_starts_are_optimal():
    rng = random.Random(3)
    for _ in range(150):
        f = np.array([rng.randint(1, 9) for _ in range(rng.randint(1, 9))], np.int64)

        def cost(starts):
            edges = [*starts, len(f)]
            return sum((b - a) * f[a:b].max() for a, b in itertools.pairwise(edges)) + len(starts) * 1.5 * f.mean()

        want = min(cost((0, *c)) for k in range(len(f)) for c in itertools.combinations(range(1, len(f)), k))
        got = block_max.block_starts([f[:2], f, f[::-1].copy()], block_cost=1.5, grain=1)
        assert cost(list(got[1])) == pytest.approx(want) and got[1][0] == got[0][0] == 0
        coarse = block_max.block_starts([f], grain=4)[0]
        assert set(coarse) <= {0, 4, 8} and coarse[0] == 0


def brute_search(rows, queries, k=10):
    held = [(r[0], Counter(words(r[1]))) for r in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, length, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in queries:
        scored = []
        for doc_id, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 24])
def test_search_equals_brute_force(spark, rows, docs, shard_bytes):
    rng = random.Random(4)
    queries = [(i, " ".join(rng.choice(words(rows[k][1])) for _ in range(rng.randint(1, 30)))) for i, k in enumerate([0, 3, 5, 60, 100, 165])]
    queries += [(5, "nowhere"), (6, None), (7, ""), (None, rows[2][1]), (5, rows[165][1][:200])]
    items = spark.createDataFrame(queries, "item_id long, text string")
    index = block_max.build_index(docs, shard_bytes=shard_bytes)
    for block_bytes in (1 << 22, 400):
        got = block_max.search(index, items, block_bytes=block_bytes)
        assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_search(rows, queries)


def test_blocks_are_skipped():
    """A few high postings among many low ones: most stretches are never scored."""
    low = np.full(40_000, 100, np.int64)
    low[[17, 900, 33333]] = 100000
    places, scored = np.arange(40_000), []
    lists = [(2, block_max.Postings(places, low, block_max.block_starts([low])[0])), (1, block_max.Postings(places[::2], low[::2], block_max.block_starts([low[::2]])[0]))]
    for _, postings in lists:
        postings.score = lambda wanted, take=postings.score: scored.append(len(wanted)) or take(wanted)
    got = block_max.best_of_shard(lists, places, 3)
    assert sorted(got[0]) == [17, 900, 33333] and max(scored) < 1500


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert block_max.search(block_max.build_index(none), items).collect() == []
    assert block_max.search(block_max.build_index(docs), none.select("item_id", "text")).columns == ["item_id", "rank", "doc_id", "score"]


def test_kernel_is_the_presence_kernel():
    def grams(text):
        data = string_kernel.letters(text)
        return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}

    texts = ["Ein Haus, ein Baum", "la maison", "L'été: 33 fois", "the house " * 50]
    model = string_kernel.KernelModel.of([string_kernel.spectrum(t, 3, 24) for t in texts[:3]], ["x"], 3, 24)
    known = set().union(*map(grams, texts[:3]))
    want = [[len(grams(a) & grams(b)) / math.sqrt(len(grams(a) & known) * len(grams(b))) for b in texts[:3]] for a in texts]
    assert np.allclose(model.kernel(texts), want, atol=1e-6)


def test_buffers_do_not_change_a_spectrum(monkeypatch):
    text = "".join(random.Random(5).choice("abcdé ") for _ in range(5000))
    want = string_kernel.spectrum(text, 4, 20)
    monkeypatch.setattr(string_kernel, "BUFFER", 7)
    assert np.array_equal(string_kernel.spectrum(text, 4, 20), want)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = string_kernel.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in tested) / len(tested) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_is_never_an_input_of_a_prediction(spark):
    """Labels of held-out rows, sources and ids change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(string_kernel.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in df.collect())
    assert key(string_kernel.identify(docs)) == key(string_kernel.identify(other))


def test_languages_of_odd_rows(spark, docs, none):
    named = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 5 == 0, "bb"))
    got = string_kernel.identify(named).collect()
    assert len(got) == docs.count() and {r["lang_pred"] for r in got} <= {"aa", "bb", "und"}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts[r["doc_id"]] or "")) for r in got if r["doc_id"] is not None)
    assert {r["lang_pred"] for r in string_kernel.identify(docs).collect()} == {"und"}
    assert string_kernel.identify(none).collect() == []
