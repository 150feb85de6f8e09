"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread

#: Rows that one Arrow batch may hold: texts reach 100 kB and more, and a batch is in a worker's memory at once.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if one task would read it, dealt out before costly work."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: What may be broadcast: bytes of rows, estimated from their values.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: strings by their length, nested values by that of their JSON text."""

    def of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if kind.startswith(("array", "struct", "map")) else F.lit(8)

    return sum((of(n, k) for n, k in df.dtypes), F.lit(16))


def few(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` to be broadcast if all its rows take few bytes, measured on them, else as it is. Give a written table."""
    size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what an Arrow batch holds, so that many long texts don't fill a Python worker; its bytes Spark bounds by itself (64 MB)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, fn: Callable[[Iterable], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` gets an iterator over the rows (as tuples) of an Arrow batch and yields output tuples.

    Values are plain Python ones, so an id next to a null stays a whole number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(fn(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            columns = zip(*rows, strict=True) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever case they are in."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once a row, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)
