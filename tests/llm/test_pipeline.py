import collections

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factweave.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF).persist()
        seen.append((name, now, after))
        now = after
    names = [n for n, _, _ in seen]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "pack_sequences"]
    assert all(a.columns == docs.columns for _, _, a in seen[:-1])
    rejected = {r.doc_id for r in seen[0][1].collect()} - {r.doc_id for r in seen[0][2].collect()}
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert rejected and all(d in rejected for d, t in texts.items() if len(t.split()) < 20)
    assert sum(marked.get(d) == 1 and len(texts[d].split()) >= 20 for d in rejected) <= 2
    kept = [r.doc_id for r in seen[1][2].collect()]
    assert len(kept) == len(set(kept)) <= seen[1][1].count()
    assert seen[2][2].count() == len(kept) and not seen[2][2].where("text RLIKE '@mail[0-9]+[.]example[.]com'").count()
    copies = collections.Counter(r.doc_id for r in seen[3][2].collect())
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(kept)
    pieces = seen[4][2].collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_every_operator_is_registered():
    known = entry.queries()
    assert "pipeline" in known and all(any(q.startswith(f"op{n}_") for q in known) for n in range(1, 14))
