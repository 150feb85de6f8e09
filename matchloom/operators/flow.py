"""Markov clustering by products of sparse matrices.

The matrix is its entries (i, j, y), with the blocks of their row and column (ib, jb): nodes are numbered component by component and dealt
to blocks in that order. Squaring is a product of blocks: a tile of the result gets a block of rows and one of columns, so its sums are whole
where they are made and no partial sum is shuffled. Inflation and scaling are aggregates by column. No component is held by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard
from .components import connected_components
from .ranking import with_position

#: Nodes of a block.
BLOCK = 512


def scaled(matrix: DataFrame) -> DataFrame:
    """Columns that sum up to 1."""
    total = cut(matrix.groupBy("j").agg(F.sum("y").alias("t")), "columns")
    return matrix.join(total, "j").select("i", "j", (F.col("y") / F.col("t")).alias("y"), "ib", "jb")


def blocks(edges: DataFrame) -> DataFrame:
    """(node, block) of the nodes of ``edges`` (id1, id2): those of a component are neighbours."""
    placed = with_position(connected_components(edges), ["component", "node"])
    return placed.select("node", F.floor(F.col("position") / BLOCK).alias("block"))


def product(tile: tuple, rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
    """(i, j, y, ib, jb) of a tile: ``rows`` (i, k, y) times ``columns`` (k, j, z), column by column."""
    rows, columns = rows.sort_values("k"), columns.sort_values(["j", "k"])
    k, y, j, z = (t[c].to_numpy() for t, c in ((rows, "k"), (rows, "y"), (columns, "j"), (columns, "z")))
    ids, at = np.unique(rows["i"].to_numpy(), return_inverse=True)
    low, high = (np.searchsorted(k, columns["k"].to_numpy(), side) for side in ("left", "right"))
    starts = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
    out = []
    for s, e in zip(starts, [*starts[1:], len(j)], strict=True):
        met = [slice(*x) for x in zip(low[s:e], high[s:e], strict=True)]
        where, n = np.concatenate([at[x] for x in met]), high[s:e] - low[s:e]
        sums = np.bincount(where, np.concatenate([y[x] for x in met]) * np.repeat(z[s:e], n), len(ids))
        hit = np.flatnonzero(np.bincount(where, minlength=len(ids)))
        out.append((ids[hit], np.full(len(hit), j[s]), sums[hit]))
    i, j, y = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"i": i, "j": j, "y": y, "ib": tile[0], "jb": tile[1]})


def squared(matrix: DataFrame) -> DataFrame:
    """The matrix times itself: a row's entry goes to the blocks of columns that its own column's block has entries in, and a column's likewise."""
    some = cut(matrix.select("ib", "jb").distinct(), "blocks")  # pairs of blocks that have an entry
    own = lambda df, names: df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
    rows = own(own(matrix, {"jb": "kb", "j": "k"}).join(own(some, {"ib": "kb"}), "kb").drop("kb"), {})
    columns = own(own(matrix, {"ib": "kb", "i": "k", "y": "z"}).join(own(some, {"jb": "kb"}), "kb").drop("kb"), {})
    kind = matrix.schema["i"].dataType.simpleString()
    return rows.groupBy("ib", "jb").cogroup(columns.groupBy("ib", "jb")).applyInPandas(product, f"i {kind}, j {kind}, y double, ib long, jb long")


def markov(edges: DataFrame, rounds: int = 2, epsilon: float = 1e-5, least: float = 1e-3, inflation: float = 2.0) -> DataFrame:
    """(cluster_id, profile_id) of the nodes of ``edges`` (id1 < id2, weight): flow expands and is inflated in turn until it stays, at most ``rounds`` times; nodes between which more than ``least`` is left are one cluster."""
    nodes = edges.select(F.explode(F.array("id1", "id2")).alias("i")).distinct()
    loops = nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("y"))
    entries = loops.unionByName(edges.select(F.col("id1").alias("i"), F.col("id2").alias("j"), F.col("weight").alias("y")))
    of = cut(blocks(edges), "of")
    for side in "ij":
        entries = entries.join(of.select(F.col("node").alias(side), F.col("block").alias(f"{side}b")), side)
    now = cut(scaled(cut(entries, "matrix")), "flow")
    for k in range(1, rounds + 1):
        raised = cut(squared(now).withColumn("y", F.pow("y", F.lit(inflation))), "expanded")
        after = cut(scaled(raised), "flow")
        discard(raised)
        moved = after.join(now.select("i", "j", F.col("y").alias("before")), ["i", "j"], "left").where(F.abs(F.col("y") - F.coalesce("before", F.lit(0.0))) >= epsilon)
        still = k < rounds and not moved.limit(1).count()  # nothing depends on it after the last round
        discard(now)
        now = after
        if still:
            break
    left = now.where(F.col("y") > least)
    found = connected_components(left, "i", "j")
    linked = found.select(F.col("component").alias("cluster_id"), F.col("node").alias("profile_id"))
    alone = nodes.select(F.col("i").alias("profile_id")).join(linked, "profile_id", "left_anti")
    return linked.unionByName(alone.select(F.col("profile_id").alias("cluster_id"), "profile_id"))
