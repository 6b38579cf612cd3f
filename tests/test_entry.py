import ast
import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from factweave import oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_spark_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(oracle.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert rows == sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_no_statement_is_given_twice_and_each_reads_a_table():
    """Keys of one dictionary, and of all that are merged into ORACLE_SQL; a later key would hide an earlier statement."""
    tree = ast.parse(Path(oracle.__file__).read_text())
    merged = []
    for node in tree.body:
        value = getattr(node, "value", None)
        if isinstance(value, ast.Dict):
            keys = [k.value for k in value.keys if isinstance(k, ast.Constant)]
            assert len(keys) == len(set(keys))
            merged += keys
    assert len(merged) == len(set(merged)) and set(merged) == set(oracle.ORACLE_SQL)
    for name, sql in oracle.ORACLE_SQL.items():
        assert any(re.search(rf"\b{t}\b", sql) for t in TABLES), name
