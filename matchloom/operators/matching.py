"""Scores of candidate pairs (id1, id2) over profiles.

A profile's terms, or its pairs of characters, are one packed value with their counts, and a pair is one row with both.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..functions import keys as K
from ..storage import cut

SCORES = ("jaccard", "enhanced_jaccard", "generalised_jaccard", "cosine", "character_cosine")


def bags(profiles: DataFrame, terms: Column) -> DataFrame:
    """(id, term, n): how often a profile has a term."""
    return profiles.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def _bag(words: str) -> bytes | None:
    """How often a text has each of its words, packed."""
    return zlib.compress(pickle.dumps(dict(Counter(words.split(" ")))), 1) if words else None


#: What a pair has in common, from its counts of shared terms and all of either side: terms, minima, minima of shares, products.
COMMON: dict[str, Callable[[list[int], list[int], int, int], float]] = {
    "terms": lambda x, y, t1, t2: len(x),
    "minima": lambda x, y, t1, t2: sum(map(min, x, y)),
    "shares": lambda x, y, t1, t2: sum(map(min, [n * t2 for n in x], [n * t1 for n in y])) / (t1 * t2),
    "products": lambda x, y, t1, t2: sum(map(mul, x, y)),
}


def _scored(pairs: DataFrame, profiles: DataFrame, common: str, score: Column) -> DataFrame:
    """Pairs scored from the bags of their terms, one packed value a profile: one row a pair, no term is dealt out by itself.

    ``score`` is over m, what a pair has in common, and each side's d (distinct terms) and q (squares of counts).
    """
    of = COMMON[common]

    def packed(words: pd.Series) -> pd.Series:
        return words.map(_bag)

    def compared(batches):
        @lru_cache(64)  # rows come in order of the second side, so its bags are read once
        def read(v: bytes) -> tuple[dict[str, int], int, int]:
            bag = pickle.loads(zlib.decompress(v))
            n = bag.values()
            return bag, sum(n), sum(map(mul, n, n))

        for rows in batches:
            out = []
            for v, w in zip(rows["v1"], rows["v2"], strict=True):
                (a, t1, q1), (b, t2, q2) = read(v), read(w)
                both = a.keys() & b.keys()
                out.append((float(of([a[t] for t in both], [b[t] for t in both], t1, t2)), len(a), len(b), q1, q2))
            yield pd.concat([rows[["id1", "id2"]].reset_index(drop=True), pd.DataFrame(out, columns=["m", "d1", "d2", "q1", "q2"])], axis=1)

    words = F.array_join(K.tokens(F.col("attributes")), " ")
    rows = cut(profiles.select("id", F.pandas_udf(packed, BinaryType())(words).alias("v")), "bags").where("v is not null")
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("id1", "id2"))
    for side in ("1", "2"):
        pairs = pairs.join(rows.select(F.col("id").alias(f"id{side}"), F.col("v").alias(f"v{side}")), f"id{side}")
    sums = pairs.select("id1", "id2", "v1", "v2").mapInPandas(compared, f"{kinds}, m double, d1 long, d2 long, q1 long, q2 long")
    return sums.select("id1", "id2", score.alias("score"))


#: A pair of characters and how often it occurs. Tokens are ASCII letters and digits, so a pair is 16 bits; a single character is itself.
BIGRAM = np.dtype([("pair", "<u2"), ("n", "<u4")])


def _bigrams(text: str) -> bytes:
    """Sorted pairs of neighbouring characters with their counts."""
    b = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint16)
    found, n = np.unique((b[:-1] << 8) | b[1:] if len(b) > 1 else b, return_counts=True)
    out = np.empty(len(found), BIGRAM)
    out["pair"], out["n"] = found, n
    return out.tobytes()


def _product(a: bytes, b: bytes) -> int:
    """The sum of products of counts over the pairs that both have."""
    a, b = np.frombuffer(a, BIGRAM), np.frombuffer(b, BIGRAM)
    at = np.minimum(np.searchsorted(b["pair"], a["pair"]), len(b) - 1)
    return int(((b["pair"][at] == a["pair"]) * a["n"].astype(np.int64) * b["n"][at]).sum())


def _character_cosine(pairs: DataFrame, profiles: DataFrame, score: Column) -> DataFrame:
    """Pairs scored from packed counts of character pairs, at most some 1,300 a profile: one row a pair, made of either side's bytes."""

    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(_bigrams)

    def products(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_product(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    text = F.array_join(K.token_set(F.col("attributes")), "")
    rows = cut(profiles.select("id", F.pandas_udf(packed, BinaryType())(text).alias("v")), "bigrams").where(F.length("v") > 0)
    product = F.pandas_udf(products, LongType())
    rows = cut(rows.select("id", "v", product("v", "v").alias("q")), "squares")
    for side in ("1", "2"):
        pairs = pairs.join(rows.select(F.col("id").alias(f"id{side}"), F.col("v").alias(f"v{side}"), F.col("q").alias(f"q{side}")), f"id{side}")
    return pairs.select("id1", "id2", "q1", "q2", product("v1", "v2").alias("p")).select("id1", "id2", score.alias("score"))


def score(pairs: DataFrame, profiles: DataFrame, how: str = "jaccard") -> DataFrame:
    """(id1, id2, score). Profiles without a term have no score: such pairs are left out."""
    cosine = lambda p: F.try_divide(F.col(p).cast("double"), F.sqrt(F.col("q1").cast("double") * F.col("q2")))
    of_sets = F.try_divide(F.col("m"), F.col("d1") + F.col("d2") - F.col("m"))
    of_bags = {
        "jaccard": ("terms", of_sets),
        "enhanced_jaccard": ("minima", of_sets),  # a bag above, sets below: may exceed 1
        "generalised_jaccard": ("shares", F.try_divide(F.col("m"), 2 - F.col("m"))),  # shares sum up to 1 on either side
        "cosine": ("products", cosine("m")),
    }
    if how in of_bags:
        return _scored(pairs, profiles, *of_bags[how])
    if how == "character_cosine":
        return _character_cosine(pairs, profiles, cosine("p"))
    raise ValueError(f"no such score: {how}; one of {SCORES}")


def match(pairs: DataFrame, profiles: DataFrame, how: str = "jaccard", min_weight: float = 0.5) -> DataFrame:
    """(id1, id2, weight) of the pairs with at least ``min_weight``."""
    return score(pairs.where("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct(), profiles, how).where(F.col("score") >= min_weight).withColumnRenamed("score", "weight")


def magnitude(bag: DataFrame) -> DataFrame:
    """(id, magnitude): the length of the vector of term shares."""
    t = bag.groupBy("id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return t.select("id", (F.sqrt(F.col("q").cast("double")) / F.col("t")).alias("magnitude"))


def attribute_edges(pairs: DataFrame, profiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id1, id2, i1, i2, name1, name2, similarity): attributes of a pair with Jaccard above ``threshold``."""
    rows = profiles.select("id", F.posexplode("attributes").alias("i", "a")).select("id", "i", F.col("a.key").alias("name"), F.array_distinct(K.text_tokens(F.col("a.value"))).alias("t")).where(F.size("t") > 0)
    side = lambda s: rows.select(F.col("id").alias(f"id{s}"), F.col("i").alias(f"i{s}"), F.col("name").alias(f"name{s}"), F.col("t").alias(f"t{s}"))
    both = F.size(F.array_intersect("t1", "t2"))
    met = pairs.select("id1", "id2").join(side(1), "id1").join(side(2), "id2")
    return met.withColumn("similarity", both / (F.size("t1") + F.size("t2") - both)).where(F.col("similarity") > threshold).drop("t1", "t2")


def group_linkage(pairs: DataFrame, profiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id1, id2, score): attributes are matched one to one, most similar first; score is the sum of similarities
    over attributes less matches, -1 without a match. A pair's edges, no more than it has attribute pairs, are one sorted array, and
    matching is a fold over it."""
    n = profiles.select("id", F.size("attributes").alias("n"))
    edge = F.struct((-F.col("similarity")).alias("less"), "name1", "name2", "i1", "i2")
    zero = F.struct(F.array().cast("array<int>").alias("used1"), F.array().cast("array<int>").alias("used2"), F.lit(0.0).alias("total"), F.lit(0).alias("matched"))

    def step(acc: Column, e: Column) -> Column:
        more = F.struct(F.array_append(acc["used1"], e["i1"]).alias("used1"), F.array_append(acc["used2"], e["i2"]).alias("used2"), (acc["total"] - e["less"]).alias("total"), (acc["matched"] + 1).alias("matched"))
        return F.when(F.array_contains(acc["used1"], e["i1"]) | F.array_contains(acc["used2"], e["i2"]), acc).otherwise(more)

    edges = attribute_edges(pairs, profiles, threshold).groupBy("id1", "id2").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    done = edges.select("id1", "id2", F.aggregate("edges", zero, step).alias("m")).select("id1", "id2", "m.total", "m.matched")
    rows = pairs.select("id1", "id2").join(done, ["id1", "id2"], "left")
    for s in ("1", "2"):
        rows = rows.join(n.select(F.col("id").alias(f"id{s}"), F.col("n").alias(f"n{s}")), f"id{s}")
    return rows.select("id1", "id2", F.when(F.col("matched").isNull(), -1.0).otherwise(F.col("total") / (F.col("n1") + F.col("n2") - F.col("matched"))).alias("score"))
