import json

import pytest
from pyspark.sql import functions as F

from factweave.sources.json_file import Folder, write_json

HEAD = {"as_of": "2024-08-15", "zero": [1, {"b": None, "a": "é\n"}], "notes": [], "alpha": {"y": 1, "x": 2}}


def read(path):
    return json.loads(path.read_text(encoding="utf-8"), object_pairs_hook=lambda pairs: {"": [k for k, _ in pairs], **dict(pairs)})


def in_order(value) -> bool:
    if isinstance(value, list):
        return all(map(in_order, value))
    if not isinstance(value, dict):
        return True
    return value[""] == sorted(value[""]) and len(set(value[""])) == len(value[""]) and all(in_order(v) for v in value.values())


def test_file_of_many_parts(spark, tmp_path):
    keys = [f"k{i * 7919 % 5000:05d}/é\"\\\n" for i in range(5000)]
    rows = spark.createDataFrame([(k, i / 7, None if i % 3 else [("z", None), (k, i)]) for i, k in enumerate(keys)], "id string, value double, deep array<struct<z:string,a:int>>").repartition(7)
    write_json(rows.withColumn("number", F.struct(F.lit(1).alias("n"), F.struct(F.lit(2).alias("y"), F.lit(3).alias("x")).alias("m"))), "id", "facts", HEAD, str(tmp_path / "facts.json"))
    found = read(tmp_path / "facts.json")
    assert in_order(found) and found[""] == ["alpha", "as_of", "facts", "notes", "zero"] and found["facts"][""] == sorted(keys)
    plain = json.loads((tmp_path / "facts.json").read_text(encoding="utf-8"))
    assert {k: v for k, v in plain.items() if k != "facts"} == HEAD
    for i, k in enumerate(keys):
        assert plain["facts"][k] == {"id": k, "value": i / 7, "deep": None if i % 3 else [{"z": "z", "a": None}, {"z": k, "a": i}], "number": {"n": 1, "m": {"x": 3, "y": 2}}}
    assert len((tmp_path / "facts.json").read_text(encoding="utf-8").splitlines()) == len(keys) + 6
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["facts.json"]


@pytest.mark.parametrize("head", [{}, {"a": 1}, {"z": 1}])
def test_no_rows_and_odd_numbers(spark, tmp_path, head):
    rows = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", None), ("d", -0.5)], "id string, value double")
    target = tmp_path / "f.json"
    write_json(rows.limit(0), "id", "facts", head, str(target))
    assert json.loads(target.read_text()) == {**head, "facts": {}}
    write_json(rows, "id", "facts", head, str(target))
    assert {k: v["value"] for k, v in json.loads(target.read_text())["facts"].items()} == {"a": None, "b": None, "c": None, "d": -0.5}


def test_parts_follow_their_numbers(spark, tmp_path):
    for n in (100000, 99999, 2):
        (tmp_path / f"part-{n:05d}-x").write_text(str(n))
    (tmp_path / "_SUCCESS").write_text("")
    assert [p.getName() for p in Folder(spark, str(tmp_path)).parts()] == ["part-00002-x", "part-99999-x", "part-100000-x"]
