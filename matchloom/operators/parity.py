"""Sets compared by parity sketches: all pairs of like size, block against block.

A sketch has a bit for each of some hash values: whether an odd number of the set's items have it. Two sketches differ in no more
bits than the sets have items apart, so a pair whose sketches differ in too many is none; all others are decided by full sets. A sketch has several
bits an item, so hardly any unlike pair is left. Twice as many bits fold into half as many by exclusive or.

Sets are dealt to blocks in order of size, and two blocks meet in one task if some of their sizes are near enough. What is shuffled and written
are sketches, once for each block that is met, and full sets, packed, once for each small tile of blocks in which they have a candidate: no row is made for
a pair before its sketches agree, however frequent its items are. Comparisons are quadratic (a few nanoseconds for 64 bits), memory is bounded by the block.
A block is a sixteenth of the sets as long as its sketches have no more than ``BYTES``, so how often a sketch is shuffled doesn't grow with the table until then.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .ranking import with_position

#: Bits of a sketch, rows of a part of a block, bytes of a block's sketches, and rows of the tiles in which full sets are compared, at most.
BITS, PART, BYTES, TILE = 1 << 15, 1 << 14, 1 << 26, 512
#: Blocks into which a table is dealt that needs no more; bytes that a row has besides its sketch; between a packed set's items, which hold no line break.
BLOCKS, ROW, BETWEEN = 16, 64, "\n"


def bits_an_item(threshold: float) -> int:
    """The smallest power of two by which sets with a fifth in common differ in a quarter more bits than sets at ``threshold`` may, 8 at most."""
    may = 1.25 * 2 * (1 - threshold) / (1 + threshold)
    return next((c for c in (1, 2, 4) if c / 2 * (1 - math.exp(-2.6 / c)) >= may), 8)


def sketch(hashes: np.ndarray, bits_each: int) -> bytes:
    bits = min(max(64, 1 << (bits_each * len(hashes) - 1).bit_length()), BITS)
    return np.packbits((np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one width as rows of ``words`` numbers of 64 bits."""
    a = np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1, words)
    return np.bitwise_xor.reduce(a, axis=1)


def first_bits(threshold: float) -> float:
    """Bits an item from which sets with an eighth of all items in common differ in a fifth more than sets at ``threshold`` may; infinite if none do."""
    may = 1.2 * 2 * (1 - threshold) / (1 + threshold)
    return next((c / 20 for c in range(2, 161) if c / 40 * (1 - math.exp(-70 / c)) >= may), math.inf)


def thinned(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches folded into any number of words."""
    return np.bitwise_xor.reduceat(rows, np.arange(words) * rows.shape[1] // words, axis=1)


def near(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of rows (position, id, n, sketch), in order of n, with ``left`` before ``right``, whose sizes and sketches allow ``threshold``.

    Sketches of just so many words that few unlike pairs are left go first; whole ones decide on those pairs. Counts in a byte may lose multiples of 256, which rules out none.
    """
    apart, each = (1 - threshold) / (1 + threshold), first_bits(threshold)
    found = [np.empty((4, 0), dtype=np.int64)]
    widths = lambda rows: rows.sort_values("position").groupby(rows["sketch"].str.len())
    for wide, rows in widths(right):
        at, n, ids = (rows[c].to_numpy() for c in ("position", "n", "id"))
        for other, mine in widths(left):
            words = min(wide, other) // 8
            b, a = folded(list(rows["sketch"]), words), folded(list(mine["sketch"]), words)
            sizes = mine["n"].to_numpy()
            few = int(min(words, max(1.0, each * (int(n.max()) + int(sizes.max())) / 128 + 1)))
            thin_b, thin_a = np.ascontiguousarray(thinned(b, few).T), thinned(a, few)
            kind = np.uint8 if few <= 7 else np.uint16
            met, ones, differ = np.empty((few, len(n)), np.uint64), np.empty((few, len(n)), np.uint8), np.empty(len(n), kind)
            ends = np.searchsorted(n, np.floor(sizes / threshold + 1e-6), "right")
            starts = np.searchsorted(at, mine["position"].to_numpy(), "right")
            last = None
            for k, (p, i, m) in enumerate(zip(mine["position"].to_numpy(), mine["id"].to_numpy(), sizes, strict=True)):
                s = slice(starts[k], ends[k])
                if s.start >= s.stop:
                    continue
                if m != last:
                    may, last = np.floor((n + m) * apart + 1e-6).astype(np.int64), m
                    most = np.minimum(may, np.iinfo(kind).max).astype(kind)
                t = slice(0, s.stop - s.start)
                np.bitwise_xor(thin_b[:, s], thin_a[k][:, None], out=met[:, t])
                np.bitwise_count(met[:, t], out=ones[:, t])
                np.add.reduce(ones[:, t], axis=0, dtype=kind, out=differ[t])
                hit = s.start + np.flatnonzero(differ[t] <= most[s])
                if few < words and len(hit):
                    hit = hit[np.bitwise_count(b[hit] ^ a[k]).sum(axis=1, dtype=np.int64) <= may[hit]]
                if len(hit):
                    found.append(np.stack([np.full(len(hit), i), ids[hit], np.full(len(hit), p // TILE), at[hit] // TILE]))
    return pd.DataFrame(dict(zip(("a", "b", "u", "v"), np.concatenate(found, axis=1), strict=True)))


def sketched(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, own, sketch, packed) of ``sets`` (id, tokens): their size, SHA-256 and sketch, and their items, deflated."""
    each = bits_an_item(threshold)

    def made(hashes: pd.Series, items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"sketch": hashes.map(lambda h: sketch(h, each)), "packed": items.map(lambda x: zlib.compress(x.encode(), 1))})

    items = F.array_join("tokens", BETWEEN)
    both = F.pandas_udf(made, "sketch binary, packed binary")(F.transform("tokens", lambda t: F.xxhash64(t)), items)
    return sets.select("id", F.size("tokens").alias("n"), F.unhex(F.sha2(items, 256)).alias("own"), both.alias("both")).select("id", "n", "own", "both.*")


def dealt(rows: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """``rows`` (position, id, n, sketch) with their block, the first and the last block that it meets.

    Parts of few rows are put together, in order, to blocks of a sixteenth of the rows or of ``BYTES``, whichever is less; ``block`` states their rows instead.
    """
    total = rows.count()
    part = block or min(max(-(-total // (4 * BLOCKS)), 512), PART)
    rows = rows.withColumn("part", F.floor(F.col("position") / part))
    each = rows.groupBy("part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("c"), F.sum(F.length("sketch") + ROW).alias("bytes"))
    share = F.lit(1.0) if block else F.least(F.lit(1.0), F.greatest(F.col("c") / max(total / BLOCKS, 512), F.col("bytes") / BYTES))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    full = each.withColumn("full", F.floor(F.coalesce(F.sum(share).over(before), F.lit(0.0)) + 1e-9))
    parts = cut(full.withColumn("block", F.dense_rank().over(Window.orderBy("full")) - 1).select("part", "block", "low", "high"), "parts")
    sizes = cut(parts.groupBy("block").agg(F.min("low").alias("low"), F.max("high").alias("high")), "blocks")  # a row a block
    x, y = sizes.alias("x"), sizes.alias("y")
    reach = (F.col("x.block") <= F.col("y.block")) & (F.col("y.low") * threshold <= F.col("x.high") + 1e-6)
    tiles = x.join(F.broadcast(y), reach).select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    last, first = tiles.groupBy(F.col("i").alias("block")).agg(F.max("j").alias("last")), tiles.groupBy(F.col("j").alias("block")).agg(F.min("i").alias("first"))
    meets = cut(parts.select("part", "block").join(last.join(first, "block"), "block"), "reach")
    return rows.join(F.broadcast(meets), "part").drop("part")  # a row a part


def met(sketches: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(a, b, u, v): ids of the sets of ``sketches`` (id, n, sketch) whose sizes and sketches allow ``threshold``, each pair once, and the tile it belongs to."""
    rows = dealt(with_position(sketches.select("id", "n", "sketch"), ["n", "id"]), threshold, block)
    tasks = 8 * sketches.sparkSession.sparkContext.defaultParallelism
    columns = [F.col(c).alias(c) for c in ("position", "id", "n", "sketch")]  # own columns on either side
    left = rows.select(F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), *columns).repartition(tasks, "i", "j")
    right = rows.select(F.explode(F.sequence("first", "block")).alias("i"), F.col("block").alias("j"), *columns).repartition(tasks, "i", "j")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda a, b: near(a, b, threshold), "a long, b long, u long, v long")


def candidates(sets: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """:func:`met` of the sets (id, tokens)."""
    return met(sketched(sets, threshold), threshold, block)


def overlaps(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """(a, b, both, n1, n2): sizes of the pairs' sets and of what they have in common."""
    of = {i: frozenset(items.split(BETWEEN) if (items := zlib.decompress(x).decode()) else ()) for i, x in zip(sets["id"], sets["packed"], strict=True)}
    rows = [(a, b, len(of[a] & of[b]), len(of[a]), len(of[b])) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
    return pd.DataFrame(rows, columns=["a", "b", "both", "n1", "n2"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, n1, n2) of ``pairs`` (a, b, u, v); a set of ``sets`` (id, packed) goes to each tile in which it has a pair once."""
    tasks = 8 * sets.sparkSession.sparkContext.defaultParallelism
    needed = pairs.select("u", "v", F.explode(F.array("a", "b")).alias("id")).distinct()
    full = needed.join(sets.select("id", "packed"), "id").select(F.col("u").alias("u"), F.col("v").alias("v"), "id", "packed").repartition(tasks, "u", "v")
    met = pairs.repartition(tasks, "u", "v").groupBy("u", "v").cogroup(full.groupBy("u", "v"))
    return met.applyInPandas(overlaps, "a long, b long, both long, n1 long, n2 long")
