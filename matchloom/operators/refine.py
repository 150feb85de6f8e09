"""Block refinement: purging of oversized blocks, filtering of each profile's largest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .blocking import keep_comparable, sizes
from .ranking import following, running_sums


def levels(blocks: DataFrame, clean: bool = False) -> DataFrame:
    """(level, cc, bc): comparisons and members in blocks of up to ``level`` comparisons."""
    return _placed_levels(blocks, clean).drop("position")


def _placed_levels(blocks: DataFrame, clean: bool) -> DataFrame:
    """:func:`levels` with their position.

    Dirty blocks have one level a size, and m members make no more than the root of 2m sizes: one window has them all.
    Clean blocks may have many more, so levels are summed up within ranges, plus what the ranges before hold.
    """
    each = blocks.groupBy(F.col("comparisons").alias("level")).agg(F.sum("comparisons").alias("c"), F.sum("size").alias("s"))
    if clean:
        return running_sums(each, "level", {"c": "cc", "s": "bc"})
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("level", (F.row_number().over(Window.orderBy("level")) - 1).cast("long").alias("position"), F.sum("c").over(upto).alias("cc"), F.sum("s").over(upto).alias("bc"))


def purge_limit(blocks: DataFrame, smooth: float, clean: bool = False) -> DataFrame:
    """One row, ``max_level``: where, from the top, comparisons stop growing faster than members."""
    if clean:
        near = following(cut(_placed_levels(blocks, clean), "levels").select("position", F.struct("level", "cc", "bc").alias("v")), "v", 2)
        rows = near.select("position", F.get("near", F.lit(0)).alias("now"), F.get("near", F.lit(1)).alias("after"))
    else:
        value = F.struct("level", "cc", "bc")
        rows = _placed_levels(blocks, clean).select("position", value.alias("now"), F.lead(value).over(Window.orderBy("level")).alias("after"))
    falls = F.col("now.bc").cast("double") * F.col("after.cc") < F.lit(smooth) * F.col("now.cc") * F.col("after.bc")
    return rows.agg(F.coalesce(F.max(F.when(falls, F.col("after.level"))), F.max(F.when(F.col("position") == 1, F.col("now.level"))), F.lit(0).cast("long")).alias("max_level"))


def purge(assignments: DataFrame, smooth: float = 1.0, clean: bool = False, keep_single_level: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """Members of blocks within the limit. A collection with one level has limit 0 and loses all, unless told otherwise.

    ``blocks`` has the sizes of the assignments' blocks, where they are known.
    """
    blocks = sizes(assignments, clean) if blocks is None else blocks
    limit = purge_limit(blocks, smooth, clean)
    if keep_single_level:
        only = blocks.agg(F.count_distinct("comparisons").alias("n"), F.max("comparisons").alias("c"))
        limit = limit.join(F.broadcast(only)).select(F.when(F.col("n") == 1, F.col("c")).otherwise(F.col("max_level")).alias("max_level"))
    small = blocks.join(F.broadcast(limit), F.col("comparisons") <= F.col("max_level")).select("key")  # one row
    return assignments.join(small, "key", "left_semi")


def _ranked(assignments: DataFrame, ratio: float, clean: bool, least: int, blocks: DataFrame | None = None) -> DataFrame:
    blocks = sizes(assignments, clean) if blocks is None else blocks
    rows = assignments.join(blocks.select("key", "comparisons"), "key")
    own = Window.partitionBy("profile_id")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("comparisons", "key"))).withColumn("own_blocks", F.count("*").over(own))
    return rows.withColumn("keep", F.greatest(F.floor(F.col("own_blocks") * ratio + 0.5), F.lit(least)))


def filter_blocks(assignments: DataFrame, ratio: float = 0.8, clean: bool = False, least: int = 0, blocks: DataFrame | None = None) -> DataFrame:
    """Each profile's smallest blocks, ``ratio`` of them (and ``least`` at least); then blocks that still compare anything.

    ``blocks`` has the sizes of the assignments' blocks (and may have more blocks), where they are known.
    """
    kept = _ranked(assignments, ratio, clean, least, blocks).where("rank <= keep").drop("comparisons", "rank", "own_blocks", "keep")
    return keep_comparable(cut(kept, "filtered"), clean)


def filter_blocks_with_ties(assignments: DataFrame, ratio: float, clean: bool = False, least: int = 0, blocks: DataFrame | None = None) -> DataFrame:
    """As :func:`filter_blocks`, with all blocks as large as the last one kept."""
    rows = cut(_ranked(assignments, ratio, clean, least, blocks), "ranked")
    if rows.where("keep = 0").head(1):
        raise ValueError("the ratio leaves a profile without blocks")
    bound = F.max(F.when(F.col("rank") <= F.col("keep"), F.col("comparisons"))).over(Window.partitionBy("profile_id"))
    kept = rows.withColumn("bound", bound).where("comparisons <= bound").drop("comparisons", "rank", "own_blocks", "keep", "bound")
    return keep_comparable(cut(kept, "filtered"), clean)
