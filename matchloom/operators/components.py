"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "id1", right: str = "id2", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is its smallest node.

    Only edges are shuffled, and minima are combined before they are. Each round is written to the shared
    folder; rounds end when the edges no longer change, which is when every component is a star.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    now = cut(edges.where(F.col(left) != F.col(right)).select(u.alias("u"), v.alias("v")).distinct(), "star")
    before = _fingerprint(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        after = cut(_small_star(_large_star(now)), "star")
        discard(now)
        now, last, before = after, before, _fingerprint(after)
        if before == last:
            break
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
