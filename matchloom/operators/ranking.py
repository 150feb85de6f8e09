"""Positions in a global order without sorting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..storage import cut


def _ranges(df: DataFrame, keys: dict) -> DataFrame:
    """``df`` dealt out by range of ``keys`` and written down with its range, so that numbers hold if a task runs again."""
    dealt = df.withColumns(keys).repartitionByRange(*[F.col(k) for k in keys]).withColumn("_range", F.spark_partition_id())
    return cut(dealt, "ranges")


def _before(dealt: DataFrame, sums: dict) -> DataFrame:
    """``_range`` and what the ranges before it hold of each sum: one row a range."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("_range").agg(*[v.alias(k) for k, v in sums.items()])
    return each.select("_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums])


def with_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``df`` with its 0-based position under ``order``: columns, ascending, which should decide all ties.

    Rows are dealt out by range, without copies of what orders them, and sorted once; a row's position is its place in its range plus the rows before the range.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed, "positions")  # numbers hold if a task runs again
    rows = placed.withColumn("_range", F.shiftright("_place", 33).cast("int"))
    out = rows.join(F.broadcast(_before(rows, {"_n": F.count("*")})), "_range")
    return out.withColumn(name, F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_n_before")).drop("_range", "_n_before", "_place")


def running_sums(df: DataFrame, by: str, sums: dict[str, str]) -> DataFrame:
    """``by`` (which decides all ties), position, and for each column of ``sums`` its sum up to the row, under the new name."""
    dealt = _ranges(df.select(by, *sums), {"_o": F.col(by)})
    upto = Window.partitionBy("_range").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = _before(dealt, {"_n": F.count("*"), **{c: F.sum(c) for c in sums}})
    own = dealt.select(by, "_range", (F.row_number().over(Window.partitionBy("_range").orderBy("_o")) - 1).cast("long").alias("_i"), *[F.sum(c).over(upto).alias(n) for c, n in sums.items()])
    out = own.join(F.broadcast(starts), "_range")
    return out.select(by, (F.col("_i") + F.col("_n_before")).alias("position"), *[(F.col(n) + F.col(f"{c}_before")).alias(n) for c, n in sums.items()])


def top_k(df: DataFrame, k: int, order: list) -> DataFrame:
    """The first ``k`` rows under ``order``, for a ``k`` that grows with the data."""
    return with_position(df, order, "_position").where(F.col("_position") < k).drop("_position")


def heaviest(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` heaviest links of ``edges`` (id1, id2, weight, links); ties go to smaller ids, and the last edge keeps what links there is room for.

    Links are counted by weight and summed up over the weights; only the edges of the one weight at the border are ranked.
    """
    edges = cut(edges.where("weight is not null").select("id1", "id2", "weight", "links"), "weights")
    sums = running_sums(edges.groupBy((-F.col("weight")).alias("by")).agg(F.sum("links").alias("c")), "by", {"c": "upto"})
    inside = F.col("upto") <= keep
    border = cut(sums.agg(F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0)).alias("kept"), F.min(F.when(~inside, F.col("by"))).alias("by")), "border")
    one = edges.join(F.broadcast(border))  # one row
    whole = one.where("by is null or -weight < by").select(*edges.columns)
    ties = one.where("-weight = by").select(F.struct("id1", "id2").alias("pair"), "links")
    ranked = running_sums(ties, "pair", {"links": "upto"}).join(F.broadcast(border))
    some = ranked.join(ties.withColumnRenamed("links", "own"), "pair").withColumn("room", F.lit(keep) - F.col("kept") - F.col("upto") + F.col("own")).where("room > 0")
    return whole.unionByName(some.select("pair.id1", "pair.id2", (-F.col("by")).alias("weight"), F.least("own", "room").alias("links")))


def _windows(n: int, edge: int):
    """Each row of one sorted partition beside the ``n - 1`` rows after it, batch by batch; the last ``edge`` rows are marked, since theirs may go on in the next partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, rest = TaskContext.get().partitionId(), 0, None

        def made(columns: list[pa.Array], rows: int, last: bool) -> pa.RecordBatch:
            shift = lambda c, k: c.slice(k, rows) if len(c) >= k + rows else pa.concat_arrays([c.slice(k), pa.nulls(rows - max(len(c) - k, 0), c.type)])
            out = [pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(at, at + rows)), pa.array(np.full(rows, last))]
            out += [shift(c, k) for k in range(n) for c in columns]
            return pa.RecordBatch.from_arrays(out, names=["_range", "_at", "_last", *[f"{c}_{k}" for k in range(n) for c in names]])

        for batch in batches:
            names = batch.schema.names
            columns = batch.columns if rest is None else [pa.concat_arrays(c) for c in zip(rest, batch.columns, strict=True)]
            ends = max(len(columns[0]) - edge, 0)
            if ends:
                yield made(columns, ends, False)
            at, rest = at + ends, [c.slice(ends) for c in columns]
        if rest is not None and len(rest[0]):
            yield made(rest, len(rest[0]), True)

    return run


def neighbours(df: DataFrame, order: list[str], values: list[str], n: int) -> DataFrame:
    """(position, v_0, ..., v_{n-1} for each v of ``values``): each row's 0-based position under ``order``, its values and those of the ``n - 1`` rows after it, null beyond the end.

    Rows are dealt out by range and sorted once, and windows are made where they are sorted; the few that reach into the
    next ranges are completed from the first and last rows of all ranges. ``order`` should decide all ties between different values.
    ``discard`` of the result deletes the windows once what is made of them is written down.
    """
    edge = max(n - 1, 1)
    of = {c: df.schema[c].dataType for c in values}
    near = [StructField(f"{c}_{k}", t) for k in range(n) for c, t in of.items()]
    schema = StructType([StructField("_range", IntegerType()), StructField("_at", LongType()), StructField("_last", BooleanType()), *near])
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*values)
    rows = cut(dealt.mapInArrow(_windows(n, edge), schema), "windows", "zstd")
    ends = cut(rows.where(F.col("_last") | (F.col("_at") < edge)).select("_range", "_at", "_last", *[f"{c}_0" for c in values]), "ends")  # a few rows a range
    starts = F.broadcast(_before(ends.groupBy("_range").agg((F.max("_at") + 1).alias("n")), {"_n": F.sum("n")}))
    after = Window.orderBy("_range", "_at")
    last = ends.select("_range", "_at", "_last", *[F.lead(f"{c}_0", k).over(after).alias(f"{c}_{k}") if k else F.col(f"{c}_0") for k in range(n) for c in values]).where("_last")
    out = rows.where(~F.col("_last")).unionByName(last).join(starts, "_range")
    out = out.select((F.col("_at") + F.col("_n_before")).alias("position"), *[f.name for f in near])
    out._matchloom_path = rows._matchloom_path
    return out


def following(rows: DataFrame, value: str, n: int, stretch: int = 65_536) -> DataFrame:
    """(position, near): each position with its ``value`` and those at the ``n - 1`` positions after it, fewer at the end.

    Positions (0, 1, ...) are dealt to stretches; only the first ``n - 1`` rows of a stretch go to the one before, too.
    """
    stretch = max(stretch, n)
    home = F.floor(F.col("position") / stretch)
    also = F.when((F.col("position") % stretch < n - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    dealt = rows.select("position", F.col(value).alias("_v"), F.explode(also).alias("_s"))
    order = Window.partitionBy("_s").orderBy("position")
    near = F.array(F.col("_v"), *[F.lead("_v", k).over(order) for k in range(1, n)])
    out = dealt.select("position", "_s", near.alias("near")).where(home == F.col("_s"))
    return out.select("position", F.filter("near", lambda x: x.isNotNull()).alias("near"))
