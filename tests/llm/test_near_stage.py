"""The pipeline's near-duplicate stage against a brute-force 0.8."""

import collections
import random

import pytest
from test_operators import SCHEMA, brute_components

import corpus_pipeline
from factweave.llm import minhash

SF = "/root/testdata/sf0.001"


def crowd(n, edits, seed=8):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 0, "", 0, 0.0, "", 0))
    return rows


def wanted(rows, percent):
    return sorted(d for d, _, component in brute_components(rows, percent).elements() if d == component)


@pytest.mark.parametrize("n,edits", [(80, 14), (30, 4)])
def test_stage_on_crowds(spark, n, edits):
    rows = crowd(n, edits)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
    assert got == wanted(rows, 80)


def test_stage_takes_pairs_between_80_and_85(spark):
    base = [f"w{i}" for i in range(54)]  # 50 shingles; one edit in the middle changes 5: 45 of 55
    rows = [(i, " ".join(words), "en", "s", 0, "", 0, 0.0, "", 0) for i, words in enumerate([base, [*base[:25], "other", *base[26:]]])]
    assert wanted(rows, 80) == [0] and wanted(rows, 85) == [0, 1]
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()] == [0]


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == wanted(rows, 80)


@pytest.mark.parametrize("percent", [80, 85])
def test_components_on_a_thousand_documents(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent=percent).collect())
    assert got == brute_components(rows, percent)


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 95])
def test_tables_miss_few_pairs_at_the_threshold(percent):
    s, side, (tables, rows) = percent / 100, minhash.first_tables(percent), minhash.last_tables(percent)
    assert 2 * (1 - s**2) ** side <= 1.1e-5 and (1 - s**rows) ** tables <= 1.1e-5 and tables * rows <= minhash.SKETCH_BITS
