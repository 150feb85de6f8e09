import json

import pytest
from conftest import pairs_of
from pyspark.sql import functions as F

from matchloom.operators import evaluate
from matchloom.sources import readers


def attributes(df):
    return {r["original_id"]: [(a["key"], a["value"]) for a in r["attributes"]] for r in df.collect()}


def test_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('id,name,tags\n 7 ,Ann,"a,b"\n8,,c\n')
    p = readers.read_csv(spark, str(f), header=True, real_id="ID", explode=True, source_id=3, start=100)
    assert attributes(p) == {"7": [("name", "Ann"), ("tags", "a"), ("tags", "b")], "8": [("tags", "c")]}
    assert {r["id"] for r in p.collect()} == {100, 101}
    assert {r["source_id"] for r in p.collect()} == {3}
    assert readers.preview(spark, str(f), header=True).count() == 2


def test_json_is_flattened(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text("\n".join(map(json.dumps, [{"rid": "1", "a": {"b": [1, {"c": "x"}], "n": None}, "z": True}, {"rid": "2", "a": "y"}])))
    p = readers.read_json(spark, str(f), real_id="rid")
    got = attributes(p)
    assert sorted(got["1"]) == [("b", "1"), ("c", "x"), ("n", "null"), ("z", "true")]
    assert got["2"] == [("a", "y")]
    assert attributes(readers.read_json(spark, str(f), "rid", keep=("z",)))["1"] == [("z", "true")]


def test_ground_truth(spark, tmp_path):
    c, j = tmp_path / "g.csv", tmp_path / "g.json"
    c.write_text("id1,id2\n8,7\n7,99\n")
    j.write_text('{"id2": 7, "id1": 8}\n')
    profiles = spark.createDataFrame([(1, "7"), (2, "8")], "id long, original_id string")
    assert pairs_of(evaluate.to_internal(readers.read_ground_truth_csv(spark, str(c)), profiles)) == {(1, 2)}
    assert pairs_of(evaluate.to_internal(readers.read_ground_truth_json(spark, str(j), "id1", "id2"), profiles)) == {(1, 2)}


def test_parquet_union_and_texts(spark, tmp_path):
    spark.createDataFrame([("a", ["X", None]), (None, None)], "n string, l array<string>").write.parquet(str(tmp_path / "t.parquet"))
    p = readers.read_parquet(spark, str(tmp_path / "t.parquet"))
    both = readers.union_sources(p, p)
    assert sorted((r["source_id"], r["id"]) for r in both.collect()) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert sorted(r["text"] for r in readers.field_text(both).collect()) == ["a x", "a x"]
    assert readers.field_text(p, "l").first()["text"] == "x"
    with pytest.raises(ValueError):
        readers.preview(spark, "x.doc")


def test_attributes_of_other_types(spark):
    df = spark.createDataFrame([(1, 2.5)], "k long, v double")
    assert [tuple(a) for a in readers.to_profiles(df, id_column="k").select(F.explode("attributes").alias("a")).select("a.key", "a.value").collect()] == [("v", "2.5")]
