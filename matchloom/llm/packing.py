"""Best-fit packing of documents into sequences by large-item matching.

Only lengths matter to a packing, and there are no more lengths than the capacity. So the driver plans over
the histogram of lengths, at most ``capacity`` counts whatever the corpus, and the pieces find their places
by their rank among the pieces of their length:

* pieces above a third of the capacity go at most two to a sequence; from the longest down each length is
  matched with the longest that still fits beside it,
* smaller ones, from the longest down, go where the least room is left that takes them; a new sequence is
  begun only if there is none.

All steps work on runs of equal sequences, so a plan has a few thousand rows at any scale.

Results for odd input, all tested: a null or empty text is a document of one token, the end mark; a document
over the capacity is cut into pieces of that length, of which the first may be shorter; repeated rows are
packed each for itself; runs of a million blanks, letters or symbols take linear time; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut
from .bpe import Codec
from .tables import few, map_rows, read
from .token_counts import byte_alphabet

#: How often a piece's row may be there before its copies are dealt to several tasks.
COPIES = 10_000
#: A run of blanks that the faster library's pattern engine isn't asked to match: its stack is bounded.
LONG_BLANKS = re.compile(r"\s{10000}")


class Encoder:
    """The vocabulary file's ids by the faster of two libraries, special strings included; tests hold it against the other.

    Texts with very long runs of blanks are encoded by the codec of ``op4_byte_bpe``, which is exact and linear.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, self.special = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")" if self.special else r"(?!)")
        self.codec = None

    def encode(self, text: str) -> list[int]:
        if not LONG_BLANKS.search(text):
            return self.fast.encode(text, allowed_special="all")
        self.codec = self.codec or Codec(self.ranks)
        out: list[int] = []
        for part in self.parts.split(text):
            out += [self.special[part]] if part in self.special else self.codec.encode(part)
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece of a document of ``n`` tokens."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, s + capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, checksum of its ids and, if asked for, the ids."""
    import numpy as np

    def run(rows):
        enc = encoder(path)
        for doc_id, text in rows:
            ids = np.array([*enc.encode(text or ""), end_id], dtype="<u4")
            for k, (s, e) in enumerate(cut_lengths(len(ids), capacity)):
                yield (doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) + ((ids[s:e].astype("int32"),) if with_ids else ())

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return map_rows(docs.select("doc_id", "text"), run, schema + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, how many of them a sequence takes, first sequence, offset there)."""
    left = {n: c for n, c in histogram.items() if c}
    closed: list[tuple[int, list]] = []  # (sequences, [(length, how many in each)])
    rooms: dict[int, list] = {}  # room left -> runs
    sizes: list[int] = []  # rooms, ascending

    def put(count: int, items: list, room: int) -> None:
        if not count:
            return
        if room == 0:
            closed.append((count, items))
            return
        if room not in rooms:
            rooms[room] = []
            insort(sizes, room)
        rooms[room].append((count, items))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        mate = next((m for m in reversed(large) if m <= capacity - n and (m < n or left[n] > 1)), None)
        if mate is None:
            put(left.pop(n), [(n, 1)], capacity - n)
            large.pop()
            continue
        pairs = left[n] // 2 if mate == n else min(left[n], left[mate])
        put(pairs, [(n, 2)] if mate == n else [(n, 1), (mate, 1)], capacity - n - mate)
        for m in (n, mate):
            left[m] -= pairs
        for m in {n, mate}:
            if not left[m]:
                large.remove(m)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(sizes, n)
            room = sizes[at] if at < len(sizes) else None
            if room is None:
                count, items, room = -(-todo // (capacity // n)), [], capacity
            else:
                count, items = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(at)
            each = room // n
            full = min(count, todo // each)
            put(full, [*items, (n, each)], room - each * n)
            todo, count = todo - full * each, count - full
            if count and todo:  # fewer than would fill one more
                put(1, [*items, (n, todo)], room - todo * n)
                todo, count = 0, count - 1
            put(count, items, room)
    out, ranks, base = [], dict.fromkeys(histogram, 0), 0
    for count, items in [*closed, *(r for runs in rooms.values() for r in runs)]:
        offset = 0
        for n, each in items:
            out.append((n, ranks[n], count * each, each, base, offset))
            ranks[n] += count * each
            offset += n * each
        base += count
    return out


def _dealt(pieces: DataFrame) -> tuple[DataFrame, Column]:
    """``pieces`` and what deals them to parts: what they are; rows that are there more than ``COPIES`` times get a number of their own, too, written down."""
    key = ["doc_id", "piece", "start", "ids_crc32"]
    often = cut(pieces.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select(*[F.col(k).alias(f"_{k}") for k in key]), "often")
    if not often.head(1):
        return pieces, F.xxhash64(*key)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    salted = pieces.join(few(often), same, "left").select(*pieces.columns, F.when(F.col("_piece").isNotNull(), F.floor(F.rand(1) * 1e9)).cast("long").alias("_salt"))
    return cut(salted, "salted"), F.xxhash64(*key, "_salt")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset. Read five times, so give a written table."""
    spark, columns = pieces.sparkSession, pieces.columns
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    places = spark.createDataFrame(rows, "length long, first long, ranks long, each int, base long, place int")
    # as many parts of a length as rows in each, so that neither numbering inside them nor summing them up is long
    parts = spark.createDataFrame([(n, math.isqrt(c) + 1) for n, c in histogram.items()], "length long, parts long")
    pieces, by = _dealt(pieces)
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(by, "parts")).drop("parts")  # one row a length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "part").agg(F.count("*").alias("m")).select("length", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("rank0"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("rank0"))
    # `places` has a few thousand rows whatever the corpus: it is made from at most `capacity` counts
    nth = F.col("rank") - F.col("first")
    placed = ranked.withColumnRenamed("length", "n").join(F.broadcast(places), (F.col("n") == F.col("length")) & nth.between(0, F.col("ranks") - 1))
    placed = placed.withColumns({"sequence_id": F.col("base") + F.floor(nth / F.col("each")), "offset": F.col("place") + nth % F.col("each") * F.col("length")})
    return placed.select(*columns, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """All documents packed; with ids, the rows of a sequence hold its tokens at their offsets."""
    return pack(cut(token_pieces(docs, path, capacity, end_id, with_ids), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
