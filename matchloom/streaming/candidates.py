"""Candidate pairs for profiles that arrive in a stream, against a collection that is already blocked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import keys as K
from ..operators.blocking import keyed


def batch_candidates(profiles: DataFrame, index: DataFrame, min_common: int = 1, make_keys: Callable[[Column], Column] = K.tokens) -> DataFrame:
    """(id, candidate, shared): members of ``index`` (key, profile_id) that share ``min_common`` blocks with a profile."""
    new = keyed(profiles, make_keys).select("key", F.col("profile_id").alias("id"))
    met = new.join(index.select("key", F.col("profile_id").alias("candidate")), "key").where("id <> candidate")
    return met.groupBy("id", "candidate").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_common)


def stream_candidates(profiles: DataFrame, index: DataFrame, path: str, checkpoint: str, min_common: int = 1, make_keys: Callable[[Column], Column] = K.tokens, **trigger) -> StreamingQuery:
    """Append each batch's candidates to the Parquet table at ``path``, one folder a batch, so a batch that is run again replaces itself.

    ``index`` is static: purge it first, as its blocks bound the pairs of a batch. A batch needs no state of the ones before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch_candidates(batch, index, min_common, make_keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return profiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
