"""Columns of documents that are called like the operators' own come out as they went in, through each stage and the run of two."""

import pytest

import corpus_pipeline
from factweave.llm import minhash, water_filling

OWN = ("__text", "__place", "__kept_id", "__whole", "__last", "__source", "__copy", "row", "id", "digest", "kept_id", "place", "draw", "whole", "last", "cut_source", "own_source", "copy",
       "size", "node", "root", "extra", "slice", "minhashes", "n_words", "kept", "component_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN)


def rows(n=30):
    texts = [" ".join(f"w{(i * 7 + k * k) % 97}x{k % 5}" for k in range(40 + i)) for i in range(n)]
    texts += [texts[0], None, "", texts[1]]
    return [(i if i % 11 else None, t, "en", ["a", None, "b"][i % 3], len(t or ""), *[f"{c}-{i}" for c in OWN]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).persist()


def own_of(found):
    return {r[OWN[0]].split("-")[1]: tuple(r[c] for c in OWN) for r in found}


@pytest.mark.parametrize("stage", [minhash.keep_one, water_filling.resample])
def test_own_columns_pass_through(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert got and all(own == tuple(f"{c}-{i}" for c in OWN) for i, own in own_of(got).items())
    given = {tuple(r) for r in rows()}
    assert all(tuple(r) in given for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_and_null_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    sf = "/root/testdata/sf0.001"
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).collect() == []
    nulls = spark.createDataFrame([(None,) * (5 + len(OWN)), (1, None, None, None, None, *OWN), (2, "", "en", None, 0, *OWN)], SCHEMA)
    got = stage(spark, nulls, sf)
    if name == "pack_sequences":
        assert sorted(r["length"] for r in got.collect()) == [1, 1, 1]
    else:
        assert got.columns == nulls.columns
        want = {"quality_rules": 0, "near_duplicates": 3, "personal_data": 3, "mix_sources": 0}[name]
        assert got.count() == want
