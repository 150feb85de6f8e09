"""The comparison graph: pairs that share blocks, and their weights.

Pairs are made by one self-join on the block key and summed up by pair; each weight is an expression over the
sums and over one row of statistics a profile. Build it from purged blocks: a block's pairs are its comparisons, and
all of them are made. A large block is dealt to tiles of ``TILE`` by ``TILE`` members, so no task has it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .blocking import sizes

TILE = 2_000
WEIGHTS = ("cbs", "js", "chi_square", "arcs", "arcs_textbook", "ejs", "ecbs")


@dataclass
class Graph:
    """``pairs``: (id1, id2, shared, entropy, arcs) with id1 < id2; ``nodes``: (id, blocks, degree, log_product); totals in one row."""

    pairs: DataFrame
    nodes: DataFrame
    totals: DataFrame
    clean: bool


def tiled(rows: DataFrame, size: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a block's self-join with ``tile`` to join on: member x of part i meets y of part j >= i in tile (i, j)."""
    parts = F.ceil(F.col(size) / TILE).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), "parts")).otherwise(0).cast("int"))
    after = F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j")))
    before = F.transform(F.sequence(F.lit(0), F.col("part")), lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
    return tuple(dealt.withColumn("tile", F.explode(side)).drop("parts", size) for side in (after, before))


def build(assignments: DataFrame, clean: bool = False, entropy: str | None = None, min_common: int = 1) -> Graph:
    """``entropy`` names a column of ``assignments``; degrees count neighbours that share ``min_common`` blocks."""
    assignments = assignments.select("key", "profile_id", "source_id", (F.col(entropy) if entropy else F.lit(1.0)).cast("double").alias("h"))
    assignments = cut(assignments, "assignments")  # read for sizes and members
    blocks = cut(sizes(assignments, clean), "blocks")
    rows = assignments.join(blocks, "key").select("key", F.col("profile_id").alias("id"), "source_id", "size", "comparisons", "h")
    rows = cut(rows, "members")  # read for both sides of pairs and for nodes
    a, b = tiled(rows, "size")
    a, b = a.alias("a"), b.select("key", "tile", "id", "source_id", "part").alias("b")
    apart = (F.col("a.source_id") != F.col("b.source_id")) if clean else F.lit(True)
    once = (F.col("a.part") != F.col("b.part")) | (F.col("a.id") < F.col("b.id"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") == F.col("b.tile")) & once & apart)
    pair = [F.least("a.id", "b.id").alias("id1"), F.greatest("a.id", "b.id").alias("id2")]
    pairs = met.groupBy(*pair).agg(F.count("*").alias("shared"), F.sum("h").alias("entropy"), F.sum(1 / F.col("comparisons").cast("double")).alias("arcs"))
    pairs = cut(pairs, "pairs")
    near = pairs.where(F.col("shared") >= min_common)
    degree = near.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    nodes = rows.groupBy("id").agg(F.count("*").alias("blocks"), F.sum(F.ln(F.col("comparisons").cast("double"))).alias("log_product"), F.sum("h").alias("own_entropy"), F.sum(1 / F.col("comparisons").cast("double")).alias("own_arcs"))
    nodes = cut(nodes.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "nodes")
    totals = blocks.agg(F.count("*").alias("n_blocks"), F.sum("size").alias("members")).join(F.broadcast(near.agg(F.count("*").alias("n_edges"))))
    return Graph(pairs, nodes, totals, clean)


def weight(scheme: str, integer_ratio: bool = False) -> Column:
    """A weight over columns shared, arcs, blocks1/2, degree1/2, log_product1, n_blocks, n_edges; undefined ones are null."""
    s, b1, b2, n = (F.col(c).cast("double") for c in ("shared", "blocks1", "blocks2", "n_blocks"))
    js = s / (b1 + b2 - s)
    if scheme == "cbs":
        return s
    if scheme == "js":
        return js
    if scheme == "chi_square":
        cross = s * (n - b1 - b2 + s) - (b1 - s) * (b2 - s)
        return F.try_divide(n * cross * cross, b1 * b2 * (n - b1) * (n - b2))
    if scheme == "arcs":
        return s * F.exp(-F.col("log_product1"))
    if scheme == "arcs_textbook":
        return F.col("arcs")
    if scheme == "ejs":
        e = F.col("n_edges").cast("double")
        part = lambda d: F.log10(e / F.when(F.col(d) == 0, F.lit(1e-11)).otherwise(F.col(d).cast("double")))
        return js * part("degree1") * part("degree2")
    if scheme == "ecbs":
        ratio = (lambda b: F.floor(n / b)) if integer_ratio else (lambda b: n / b)
        return s * F.log10(ratio(b1)) * F.log10(ratio(b2))
    raise ValueError(f"no such weight: {scheme}; one of {WEIGHTS}")


def _with_nodes(pairs: DataFrame, graph: Graph) -> DataFrame:
    for side in ("1", "2"):
        own = graph.nodes.select(F.col("id").alias(f"id{side}"), *[F.col(c).alias(f"{c}{side}") for c in ("blocks", "degree", "log_product")])
        pairs = pairs.join(own, f"id{side}")
    return pairs.join(F.broadcast(graph.totals))  # one row


def weighted(graph: Graph, scheme: str = "cbs", use_entropy: bool = False, integer_ratio: bool = False) -> DataFrame:
    """(id1, id2, weight)."""
    w = weight(scheme, integer_ratio) * (F.col("entropy") if use_entropy else F.lit(1.0))
    return _with_nodes(graph.pairs, graph).select("id1", "id2", w.alias("weight"))


def neighbourhoods(graph: Graph, scheme: str = "cbs", use_entropy: bool = False, include_self: bool | None = None) -> DataFrame:
    """(node, neighbour, weight) in both directions; in dirty graphs a node is its own neighbour, too, unless told otherwise."""
    own = graph.nodes.select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.col("blocks").alias("shared"), F.col("own_entropy").alias("entropy"), F.col("own_arcs").alias("arcs"))
    include_self = (not graph.clean) if include_self is None else include_self
    w = weight(scheme) * (F.col("entropy") if use_entropy else F.lit(1.0))
    rows = _with_nodes(graph.pairs.unionByName(own) if include_self else graph.pairs, graph).select("id1", "id2", w.alias("weight"))
    two = F.when(F.col("id1") == F.col("id2"), F.array(F.struct(F.col("id1").alias("a"), F.col("id2").alias("b")))).otherwise(F.array(F.struct(F.col("id1").alias("a"), F.col("id2").alias("b")), F.struct(F.col("id2").alias("a"), F.col("id1").alias("b"))))
    return rows.select(F.explode(two).alias("p"), "weight").select(F.col("p.a").alias("node"), F.col("p.b").alias("neighbour"), "weight")
