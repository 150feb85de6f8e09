"""Exact top-k search by a vector-approximation file.

Equal vectors are one row of the file, with the few smallest ids that can matter (ties go to smaller ids). Beside its
exact vector a row has a cell of one byte a component: the component without its low bits, as many as the largest
component of the table needs. The file is written down once, and its columns are read apart:

1. the cells alone are scanned. Inner products with the cells' lower corners bound every score from below and above;
   a row is left for a query if its upper bound reaches the k-th best lower bound, first of its block, then of all;
2. exact vectors are joined with what is left, best bound first: ``FIRST`` a query, and then, of the others, those
   whose upper bound still reaches the k-th exact score. All others are certain to be no result. What is left goes to the
   exact vectors if it takes few bytes, so these aren't shuffled; their column is read once, and again if a second round is needed.

Queries are a stated set, met with all cells block by block: a grid of (row block, query block) deals both out
evenly, and a task holds one block of either. Nothing is sampled, so the result is exact. The README has how many exact
vectors are used.

Results for odd input, all tested: vectors that are null or hold null or non-finite components take no part,
neither as candidates nor as queries; nor do rows without an id; shorter vectors count as filled up with zeros;
rows with the query's id are the query's own; repeated rows are candidates each; a query id with several vectors
takes the best of their scores for each candidate; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, discard
from .tables import few, read

#: Rows and queries in a block; queries scanned at a time; exact vectors read first for a query.
VECTORS, QUERIES, AT_ONCE, FIRST = 16_384, 2_048, 128, 20


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * component), for the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * float(scale)).cast("long")).alias("v"))


def approximation_file(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(key, v, cells, ids) for each different vector, and how many low bits its cells leave out.

    ``ids`` has the k + 1 smallest ids (one may be the query's own), each with how many rows it has.
    """
    most = vectors.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0
    bits = max(0, int(most).bit_length() - 7)
    each = vectors.groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = each.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    rows = rows.withColumn("key", F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b")))
    return cut(rows.withColumn("cells", F.transform("v", lambda x: F.shiftright(x, bits).cast("tinyint"))), "file"), bits


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def block_bounds(cells: np.ndarray, bits: int, queries: np.ndarray, k: int, own):
    """Yield (query's place, rows, lower, upper) of the block's rows that may be among the k best; ``own(i)`` marks rows to be left out."""
    corners, width = cells << bits, (1 << bits) - 1
    safe = (float(np.abs(corners).max(initial=0)) + width) * float(np.abs(queries).max(initial=0)) * cells.shape[1] < 2**52  # sums of floats are exact
    if safe:
        corners = corners.astype(np.float64)
    for at in range(0, len(queries), AT_ONCE):
        part = queries[at : at + AT_ONCE]
        base = ((part.astype(np.float64) if safe else part) @ corners.T).astype(np.int64)
        over, under = width * np.where(part > 0, part, 0).sum(axis=1), width * np.where(part < 0, part, 0).sum(axis=1)
        for i in range(len(part)):
            left = np.flatnonzero(~own(at + i))
            if len(left):
                b = base[i, left]
                if len(left) > k:
                    stay = b + over[i] >= np.partition(b, len(b) - k)[len(b) - k] + under[i]
                    left, b = left[stay], b[stay]
                yield at + i, left, b + under[i], b + over[i]


def candidates(file: DataFrame, bits: int, queries: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, query, key, lower, upper): what the scan of the cells leaves. ``queries`` is (query_id, query, q)."""
    sizes = file.agg(F.count("*").alias("n")).first()["n"], queries.count()
    n_v, n_q = max(1, math.ceil(sizes[0] / VECTORS)), max(1, math.ceil(sizes[1] / QUERIES))
    if n_v == 1:  # few vectors: the queries are still dealt to several tasks
        n_q = max(n_q, min(6, math.ceil(sizes[1] / 64) or 1))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda column, n: F.pmod(F.col(column), F.lit(n)).cast("int")
    only = F.when(F.size("ids") == 1, F.get("ids", F.lit(0))["vec_id"])
    left = file.select(part("key.a", n_v).alias("vb"), every(n_q).alias("qb"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.coalesce(only, F.lit(0)).alias("only"), only.isNotNull().alias("single"), "cells")
    right = queries.select(every(n_v).alias("vb"), part("query.a", n_q).alias("qb"), "query_id", F.col("query.a").alias("qa"), F.col("query.b").alias("qc"), "q")
    names = ("query_id", "qa", "qc", "a", "b", "lower", "upper")

    def meet(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = [[] for _ in names]
        if len(vs) and len(qs):
            cells, q = _matrix(vs["cells"], width), _matrix(qs["q"], width)
            only, single, a, b = (vs[c].to_numpy() for c in ("only", "single", "a", "b"))
            ids, qa, qc = (qs[c].to_numpy() for c in ("query_id", "qa", "qc"))
            for i, rows, lower, upper in block_bounds(cells, bits, q, k, lambda i: single & (only == ids[i])):
                for column, values in zip(out, (np.full(len(rows), ids[i]), np.full(len(rows), qa[i]), np.full(len(rows), qc[i]), a[rows], b[rows], lower, upper), strict=True):
                    column.append(values)
        return pd.DataFrame({n: np.concatenate(c).astype("int64") if c else np.empty(0, dtype="int64") for n, c in zip(names, out, strict=True)})

    met = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(meet, ", ".join(f"{n} long" for n in names))
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return met.select("query_id", pair("qa", "qc").alias("query"), pair("a", "b").alias("key"), "lower", "upper")


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(query_id, query, least): the k-th best of each query, where it has so many."""
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col(value).desc()))
    return rows.select("query_id", "query", value).withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "query", F.col(value).alias("least"))


def _scores(pairs: DataFrame, file: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` (query_id, query, key) with the exact score and the row's ids: the only place where exact vectors are read."""
    met = file.select("key", "v", "ids").join(few(pairs.select("query_id", "query", "key")), "key").join(few(queries), ["query_id", "query"])
    product = F.aggregate(F.zip_with("v", "q", lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return met.select("query_id", "query", "key", "ids", product.alias("score"))


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """The k best inner products of each query among the rows of ``vectors`` (vec_id, v) with another id."""
    file, bits = approximation_file(vectors, k)
    width = file.agg(F.max(F.size("cells"))).first()[0] or 0
    mine = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b")).alias("query"), F.col("v").alias("q")).distinct()
    queries = cut(mine, "queries")
    found = cut(candidates(file, bits, queries, width, k), "candidates")
    left = found.join(_kth(found, "lower", k), ["query_id", "query"], "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least")
    order = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("upper").desc(), "key"))
    left = cut(left.withColumn("place", order), "left")
    first = cut(_scores(left.where(F.col("place") <= max(FIRST, k)), file, queries), "first")
    more = left.where(F.col("place") > max(FIRST, k)).join(_kth(first, "score", k), ["query_id", "query"]).where(F.col("upper") >= F.col("least"))
    more = cut(more, "more")
    scored = first.unionByName(_scores(more, file, queries)) if more.head(1) else first  # the second round is rarely needed, and then nothing is read for it
    rows = scored.select("query_id", "key", "score", F.explode("ids").alias("i")).where(F.col("i.vec_id") != F.col("query_id"))
    rows = rows.select("query_id", "key", "score", F.col("i.vec_id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.least(F.col("i.n"), F.lit(k)).cast("int"))).alias("copy"))
    best = rows.groupBy("query_id", "key", "vec_id", "copy").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    discard(found)
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantise(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
