import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import topk


def brute(rows, k=5):
    keep = [(i, np.floor(np.array(v, dtype=float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in keep), default=0)
    keep = [(i, np.pad(v, (0, width - len(v)))) for i, v in keep]
    out = set()
    for q, v in dict((i, v) for i, v in keep if i % 50 == 0).items():
        best = sorted((-int(v @ w), i) for i, w in keep if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize(("vectors", "queries"), [(16_384, 2_048), (40, 3)])
def test_exact(spark, monkeypatch, vectors, queries):
    monkeypatch.setattr(topk, "VECTORS", vectors)
    monkeypatch.setattr(topk, "QUERIES", queries)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(150)]
    rows += [(50_001, None), (50_050, [1.0, None]), (50_100, [float("nan")] * 8), (50_150, [float("inf")] * 8), (50_200, []), (50_250, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = topk.top_k(topk.quantise(df), F.col("vec_id") % 50 == 0)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows32)


def test_empty_few_and_repeated(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert topk.top_k(topk.quantise(none), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], schema)
    got = topk.top_k(topk.quantise(few), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(x) for x in got.select("rank", "vec_id", "score").collect()) == [(1, 1, 256 * 512), (2, 1, 256 * 512)]


def test_large_values_stay_exact(spark):
    rows = [(1, [2.0**20, 3 / 256]), (2, [2.0**20, 2 / 256]), (3, [-(2.0**20), 1 / 256]), (50, [2.0**20, 1 / 256])]
    got = topk.top_k(topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0, 2)
    assert sorted(tuple(x) for x in got.select("rank", "vec_id", "score").collect()) == [(1, 1, 2**56 + 3), (2, 2, 2**56 + 2)]


def test_one_id_with_several_vectors(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [3.0, 1.0]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (50, [1.0, 0.0])]
    got = topk.top_k(topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0)
    # a candidate row's score is the best over the query's vectors; each row of 2 is a candidate
    assert sorted(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == [(50, 1, 1, 3 * 65536), (50, 2, 2, 2 * 65536), (50, 3, 2, 65536)]


def test_the_scan_leaves_little_and_the_cells_are_bytes(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).tolist()) for i in range(3000)] + [(10_000 + i, [0.3] * 16) for i in range(500)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    file, bits = topk.approximation_file(vectors, 5)
    assert file.count() == 3001  # a vector that many rows have is one row
    assert file.schema["cells"].dataType.simpleString() == "array<tinyint>"
    assert {len(x["ids"]) for x in file.where(F.size("ids") > 1).collect()} == {6}
    queries = vectors.where("vec_id % 50 = 0 and vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b")).alias("query"), F.col("v").alias("q"))
    found = topk.candidates(file, bits, queries, 16, 5)
    assert found.count() < 60 * 3001 / 20
    exact = topk._scores(found, file, queries).join(found, ["query_id", "query", "key"])
    assert exact.where("score < lower or score > upper").count() == 0
