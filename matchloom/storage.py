"""Where intermediate tables live: the folder that the cluster names in ``spark.checkpoint.dir``.

Everything that cuts lineage is written there, so it outlives any executor. Only a local session
that names no folder (a laptop, a unit test) gets a private one; a cluster has to name one, since
files in a machine's own folder would be there for a part of the executors only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder; in a local session a private one, remembered by the context, if none is named."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame, tag: str = "cut", compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a table that no lost executor can take away. ``compression`` is the session's, if not stated."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/matchloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._matchloom_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is, or dealt out evenly if it has fewer partitions than there are cores: a small file may be one
    row group, which a single task reads, and would then do all the work on its rows, too."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_matchloom_path", None)
        if path:
            sc = table.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
