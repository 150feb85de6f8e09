"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its n-grams of 3 to 6 characters (lower-cased, white space runs as one space), each present or
not, hashed to ``2 ** BITS`` columns. Each column is scaled by the log ratio of its smoothed rates in the two
classes, and a logistic regression is fitted on the scaled columns. Whole texts are scored, in one scan.

The fit reads a bounded sample: at most ``max_rows`` labelled documents, a quarter of them of class 1, those with the
smallest hash of doc_id and text; rows repeated with one doc_id and text are one document. One task fits the sample's
column numbers; texts stay where they are read, and the driver gets the weights alone. The share of label 1 is
counted over all labelled rows and corrects for the sample's.

Results for odd input, all tested: null and empty texts have no features and get the score of the bias; without
labels of both classes the score is the share of label 1, or 0; several labels of a document count as the highest;
repeated rows are all scored; an empty table gives an empty table; clashing names don't matter, as a score is a
column expression over ``text``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, discard
from .tables import map_rows, read, small_batches

BITS, ORDERS, MAX_ROWS, THRESHOLD = 20, (3, 4, 5, 6), 4000, 0.7
_BASE, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


class Features:
    """Columns of a text; keeps one flag a column so that presence costs no sort."""

    def __init__(self):
        self.flags = np.zeros(1 << BITS, dtype=bool)

    def __call__(self, text: str | None) -> np.ndarray:
        b = " " + " ".join((text or "").lower().split()) + " "
        a = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)  # a number a character
        h = a
        for n in range(2, max(ORDERS) + 1):
            if len(a) < n:
                break
            h = h[:-1] * _BASE + a[n - 1 :]
            if n in ORDERS:
                self.flags[((h + np.uint32(n)) * _MIX) >> np.uint32(32 - BITS)] = True
        out = np.flatnonzero(self.flags)
        self.flags[out] = False
        return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, columns: np.ndarray) -> float:
        z = self.bias + float(self.weights[columns].sum(dtype=np.float64))
        return float(z > 0) if abs(z) > 700 else float(1 / (1 + np.exp(-z)))


def _packed(columns: np.ndarray) -> bytes:
    """Ascending columns in under two bytes each."""
    return zlib.compress(np.diff(columns.astype("<i4"), prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), dtype="<i4"))


def fit(packed: list[bytes], labels: np.ndarray, share: float, alpha: float = 1.0, l2: float = 1.0, least: float = 1.0, rounds: int = 120) -> Model:
    """Log-count ratios, then logistic regression by gradient steps with adaptive rates; deterministic."""
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        p = min(max(share, 0.0), 1.0)
        return Model(weights, float(np.log(p / (1 - p))) if 0 < p < 1 else (np.inf if p else -np.inf))
    rate = np.full((2, 1 << BITS), alpha)
    for c, y in zip(packed, labels, strict=True):  # text by text: no array is as long as all texts together
        rate[int(y), _unpacked(c)] += 1
    q, p = rate
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[p + q < 2 * alpha + 2] = 0  # seen once: says nothing about other texts
    told = np.abs(ratio) > least  # the rest tell the classes apart too little
    used, place = np.flatnonzero(told), np.zeros(1 << BITS, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    kept = [place[c[told[c]]] for c in map(_unpacked, packed)]
    scale = ratio[used]
    del rate, ratio, told, place, q, p
    w, b, y, n = np.zeros(len(used)), 0.0, labels.astype(float), len(labels)
    m, s, mb, sb, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.02
    for t in range(1, rounds + 1):
        scaled, g = w * scale, np.zeros_like(w)
        z = np.array([scaled[c].sum() for c in kept]) + b
        e = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) / n
        for c, x in zip(kept, e, strict=True):  # a text has a column once
            g[c] += x
        g, gb = g * scale + l2 * w / n, e.sum()
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    weights[used] = w * scale
    drawn = y.mean()
    return Model(weights, float(b + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))) if 0 < share < 1 else float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labels outside the held-out third."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    # at most max_rows labels are drawn; of the documents under their ids again at most max_rows, each once, and all by
    # an order that decides every tie
    drawn = _first(known, max_rows, ["doc_id"])

    def columns(rows):
        features = Features()
        for doc_id, tkey, text, y in rows:
            yield doc_id, tkey, _packed(features(text)), y

    def fitted(batches):
        got = [(y, c) for batch in batches for y, c in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
        got.sort()  # the fit doesn't depend on the order of arrival
        model = fit([c for _, c in got], np.array([y for y, _ in got], dtype=np.int64), share)
        yield pa.RecordBatch.from_pydict({"weights": [zlib.compress(model.weights.tobytes(), 1)], "bias": [model.bias]})

    key = F.xxhash64("text").alias("tkey")
    texts = docs.select("doc_id", key).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "tkey").agg(F.max("toxic").alias("toxic"))
    chosen = cut(_first(texts, max_rows, ["doc_id", "tkey"]), "drawn")
    rows = docs.select("doc_id", "text", key).join(F.broadcast(chosen), ["doc_id", "tkey"])  # at most max_rows rows, and what repeats them
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = map_rows(rows.select("doc_id", "tkey", "text", "toxic"), columns, f"doc_id {kind}, tkey long, columns binary, toxic int").dropDuplicates(["doc_id", "tkey"])
    # the sample is bounded, so one task fits it; the driver gets the weights alone
    model = sample.select("columns", "toxic").repartition(1).mapInArrow(fitted, "weights binary, bias double").first()
    discard(chosen)
    if model is None:  # no task ran on no rows
        return fit([], np.empty(0, dtype=np.int64), share)
    return Model(np.frombuffer(zlib.decompress(model["weights"]), dtype=np.float32), model["bias"])


def _first(rows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """A quarter of ``n`` rows of class 1 and the rest of class 0, those with the smallest hashes of ``by``, which tells rows apart."""
    part = lambda y, k: rows.where(F.col("toxic") == y).orderBy(F.xxhash64(*by), *by).limit(k)
    return part(1, n // 4).unionByName(part(0, n - n // 4))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of ``text`` as a column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 MB, whatever the corpus

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        features, m = Features(), shared.value
        return pd.Series([m.score(features(t)) for t in texts], dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns as they are, without those that the classifier rejects."""
    return docs.where(score_column(docs.sparkSession, train(docs, labels), F.col("text")) < THRESHOLD)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
