"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept.  ``run`` writes each stage's rows as Parquet to the folder
that all executors share and reads them again for the next.  Other columns of
documents, whatever their names, pass through all stages but the last; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import decision_list, minhash, packing, pii, water_filling
from factweave.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    Null, empty and blank texts have too few words and go; repeated rows are judged alike; without usable labels only the base rules reject.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept, _ = decision_list.quality_filter(docs, labels)
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of five-word shingles or more) stays: the one of the smallest id.

    Documents without words are unlike all others and stay; rows of one id and text count as one; a null id stays only if no other is near.
    """
    return minhash.keep_one(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, and n_chars is counted anew.

    A null text stays null; without candidates only the fixed grammars are replaced.
    """
    redacted, _ = pii.redact(docs)
    return redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it, or not at all.

    Documents without words are taken 0 times; a null source is a source; rows alike in id, source and size are taken alike.
    """
    return water_filling.resample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learned rules, hashing and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
