"""Pruning of the comparison graph; every function returns (id1, id2, weight) of the edges that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, neighbourhoods, weighted
from .ranking import heaviest


def weight_edge_pruning(graph: Graph, scheme: str = "cbs", **options) -> DataFrame:
    """Edges of at least the mean weight."""
    edges = weighted(graph, scheme, **options)
    return edges.join(F.broadcast(edges.agg(F.avg("weight").alias("mean"))), F.col("weight") >= F.col("mean")).drop("mean")  # one row


def cardinality_edge_pruning(graph: Graph, scheme: str = "cbs", keep: int | None = None, **options) -> DataFrame:
    """As many of the heaviest edges as half the members of all blocks, or ``keep`` of them; ties go to smaller ids.

    The weight at the border is found from how many edges have each weight, so only its ties are sorted.
    """
    keep = (graph.totals.first()["members"] or 0) // 2 if keep is None else keep
    return heaviest(weighted(graph, scheme, **options).withColumn("links", F.lit(1).cast("long")), keep).drop("links")


def check(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} is one of {allowed}, not {value!r}")


def weight_node_pruning(graph: Graph, scheme: str = "cbs", threshold: str = "avg", how: str = "or", chi_divider: float = 2.0, **options) -> DataFrame:
    """Edges that reach the threshold of either node, or of both; a node's is the mean or half the maximum of its weights.

    The chi-square weight has one threshold a pair instead, the root of both squares summed over ``chi_divider``.
    """
    check("threshold", threshold, ("avg", "maxdiv2"))
    check("how", how, ("or", "and"))
    near = neighbourhoods(graph, scheme, **options)
    bound = near.groupBy("node").agg((F.avg("weight") if threshold == "avg" else F.max("weight") / 2).alias("t"))
    edges = near.where("node < neighbour").select(F.col("node").alias("id1"), F.col("neighbour").alias("id2"), "weight")
    for side in ("1", "2"):
        edges = edges.join(bound.select(F.col("node").alias(f"id{side}"), F.col("t").alias(f"t{side}")), f"id{side}")
    reach = [F.col("weight") >= F.col("t1"), F.col("weight") >= F.col("t2")]
    stays = reach[0] | reach[1] if how == "or" else reach[0] & reach[1]
    if scheme == "chi_square":
        stays = F.col("weight") >= F.sqrt(F.col("t1") ** 2 + F.col("t2") ** 2) / chi_divider
    return edges.where(stays).select("id1", "id2", "weight")


def cardinality_node_pruning(graph: Graph, n_profiles: int, scheme: str = "cbs", how: str = "or", **options) -> DataFrame:
    """Edges among the k heaviest of either node, or of both; ties go to smaller ids. k is the mean number of blocks less one."""
    check("how", how, ("or", "and"))
    k = (graph.totals.first()["members"] or 0) // n_profiles - 1
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "neighbour"))
    best = neighbourhoods(graph, scheme, **options).withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("node") != F.col("neighbour")))
    pairs = best.groupBy(F.least("node", "neighbour").alias("id1"), F.greatest("node", "neighbour").alias("id2")).agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    return pairs.where(F.col("n") >= (1 if how == "or" else 2)).select("id1", "id2", "weight")
