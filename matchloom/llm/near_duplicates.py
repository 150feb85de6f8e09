"""Near-duplicates by MinHash: many universal hash minima, banding, verification, components.

A text's set is its distinct shingles of k words. Texts with equal sets form a class and go on as one. A class
has ``bands * rows`` minima of universal hashes; classes that agree on a band meet in a bucket. Every link is
confirmed on the full sets. Components come from alternating large-star and small-star rounds.

A bucket never emits its pairs. In the first rounds each member meets the bucket's leader, which is drawn by
hash and so differs from band to band: first only the most promising leader of each member, then those of
another component. What is left are buckets with several components. Their members meet tile by tile: all
but the largest component of a bucket visit its blocks, part by part; signatures rule out what is too far apart, and
sets decide over the rest, until the components of a tile are one. So no link between components is missed that
shares a band, whatever the size of the bucket.

With 25 bands of 5 a pair at 0.85 shares none with a probability of 4e-7, with the stage's 40 bands of 5 one at 0.8
with 1.3e-7; signatures rule out a pair at the threshold only beyond five standard deviations, by the binomial tail
with 4e-6 and 1.2e-6.

Results for odd input, all tested: null and empty texts have no shingles and link with nothing; a text of fewer
than k words is one shingle; very long texts are hashed in slices; repeated rows get equal results; texts under
one doc_id are one node; ids that are no whole numbers are refused; a null doc_id has no component and is kept; an empty table gives an empty table; other
columns are not read, whatever their names. The stage keeps one row of each doc_id and text; a null doc_id's rows all stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..operators.components import connected_components
from ..storage import cut, discard
from .tables import free, map_rows, read, small_batches

#: Members of a bucket, at home and as visitors, that a task holds at once; ids that may be broadcast; shingles hashed at a time.
BLOCK, BROADCAST_IDS, SLICE = 512, 1_000_000, 1024
#: Standard deviations by which an estimate may fall short of the threshold.
DEVIATIONS = 5


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_PLACES = _constants(64, 1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles; words are split at ASCII white space, A to Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], dtype=np.uint64)
    if len(w) < k:
        h = np.array([np.uint64(len(w)) + (w * _PLACES[: len(w)]).sum(dtype=np.uint64)])
    else:
        h = np.zeros(len(w) - k + 1, dtype=np.uint64) + np.uint64(k)
        for j in range(k):
            h += w[j : len(w) - k + 1 + j] * _PLACES[j]
    return np.unique(_mix(h))


class Sketch:
    """Minima of multiply-shift hashes, their bands, and one byte of each as the signature."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.a, self.b = _constants(bands * rows, 2)[:, None], _constants(bands * rows, 3)[:, None]
        self.weights, self.tags = _constants(rows, 4), _constants(bands, 5)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        least = None
        for at in range(0, len(shingles), SLICE):
            h = self.a * shingles[None, at : at + SLICE]
            h += self.b
            m = h.min(axis=1) >> np.uint64(32)
            least = m if least is None else np.minimum(least, m)
        keys = _mix((least.reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64) + self.tags)
        return keys.view(np.int64), _mix(least).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key, keys (of the bands), sig."""

    def run(batch):
        sketch = Sketch(bands, rows)
        for doc_id, text in batch:
            s = shingle_set(text, k)
            keys, sig = sketch(s) if len(s) else (np.empty(0, dtype=np.int64), b"")
            yield doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys, sig

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_key binary, keys array<long>, sig binary")


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _floor(threshold: float, n: int) -> float:
    """The least estimate that is still verified."""
    return threshold - DEVIATIONS * float(np.sqrt(threshold * (1 - threshold) / n))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids`` (id); a set of ids that is small enough goes to the texts, else both are dealt out."""
    few = ids.count() <= BROADCAST_IDS
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = cut(pairs.select("a", "b"), "pairs")
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = _texts(docs, ids)
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batch):
        last, s = None, None
        for a, b, ta, tb in batch:
            if a != last:
                last, s = a, None
            s = shingle_set(ta, k) if s is None else s
            if _linked(s, shingle_set(tb, k), percent):
                yield a, b

    out = cut(map_rows(both.select("a", "b", "ta", "tb"), run, "a long, b long"), "links")
    discard(pairs, ids)
    return out


def _leader_pairs(members: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Each member with its buckets' leaders, once a pair, with the estimate from the signatures."""
    pairs = members.where("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    sig = classes.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")

    def run(batch):
        for a, b, sa, sb in batch:
            e = float(_estimates(np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)))
            if e >= floor:
                yield a, b, e

    return map_rows(both.select("a", "b", "sa", "sb"), run, "a long, b long, estimate double")


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with ``comp``; a class without links is its own component."""
    c = components.select(F.col("node").alias("id"), F.col("component").alias("c"))
    return rows.join(c, "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs between different components."""
    for side in ("a", "b"):
        c = components.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        pairs = pairs.join(c, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.where("ca <> cb")


def _tiles(members: DataFrame) -> DataFrame:
    """Members (h, id, comp, ...) dealt to tiles (h, block, visitors) of up to about ``BLOCK`` members at home and ``BLOCK`` visitors.

    Each member is at home in one block of its bucket; those that aren't of the bucket's largest component (``minor``)
    also visit all blocks, in one part of the visitors. So every pair of different components meets, and no task has
    more than a tile at once, whatever the size of the bucket.
    """
    sizes = members.groupBy("h", "comp").agg(F.count("*").alias("n"))
    of = sizes.groupBy("h").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("most")).select("h", "m", "most.comp", "most.n")
    of = cut(of.withColumnRenamed("comp", "major").withColumnRenamed("n", "n_major"), "sizes")  # joined as a table of its own, so that a large bucket's rows can be split
    dealt = members.join(of, "h").withColumns({"homes": F.ceil(F.col("m") / BLOCK).cast("int"), "parts": F.ceil((F.col("m") - F.col("n_major")) / BLOCK).cast("int"), "minor": F.col("comp") != F.col("major")})
    home, part = F.pmod(F.xxhash64("id"), "homes").cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int")
    tile = lambda block, visitors, visits: F.struct(block.alias("block"), visitors.alias("visitors"), F.lit(visits).alias("visits"))
    at_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda v: tile(home, v, False))
    away = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda b: tile(b, part, True))
    every = F.when(F.col("minor"), F.concat(at_home, away)).otherwise(at_home)
    return dealt.withColumn("tile", F.explode(every)).select(*members.columns, "minor", "tile.*")


def _near(pdf: pd.DataFrame, floor: float):
    """Yield (visitor, rows at home near it and of another component, estimates); pairs that meet in an earlier band are left to that one."""
    sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    keys, comp, ids = np.stack(pdf["keys"].to_numpy()), pdf["comp"].to_numpy(), pdf["id"].to_numpy()
    h, visits, minor = pdf["h"].iloc[0], pdf["visits"].to_numpy(), pdf["minor"].to_numpy()
    home = np.flatnonzero(~visits)
    for i in np.flatnonzero(visits):
        other = home[comp[home] != comp[i]]
        # two visitors meet twice, in the home of either: once is enough
        other = other[~minor[other] | (ids[other] < ids[i])] if len(other) else other
        if not len(other):
            continue
        e = _estimates(sigs[other], sigs[i])
        other, e = other[e >= floor], e[e >= floor]
        if len(other):
            same = keys[other] == keys[i]
            first = keys[i][same.argmax(axis=1)] == h
            yield i, other[first], e[first]


def _rest(members: DataFrame, classes: DataFrame, docs: DataFrame, components: DataFrame, k: int, percent: int, floor: float) -> DataFrame:
    """Links between components that still share a bucket."""
    known = cut(_with_component(members.select("h", "id"), components), "members")
    mixed = cut(known.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("m > 2 and lo < hi").select("h"), "mixed")
    left = cut(_tiles(cut(known.join(mixed, "h", "left_semi"), "left")).join(classes.select("id", "keys", "sig"), "id"), "tiles")
    tile = ["h", "block", "visitors"]

    def which(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = set()
        for i, others, _ in _near(pdf, floor):
            if len(others):
                wanted.update([i, *others.tolist()])
        return pdf.iloc[sorted(wanted)][[*tile, "visits", "id"]]

    wanted = cut(left.groupBy(*tile).applyInPandas(which, "h long, block int, visitors int, visits boolean, id long"), "wanted")
    texts = _texts(docs, cut(wanted.select("id").distinct(), "ids"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        sets: dict[int, np.ndarray] = {}
        ids, comp, text = pdf["id"].to_numpy(), pdf["comp"].to_numpy(), pdf["text"].to_numpy()
        of = lambda i: sets[i] if i in sets else sets.setdefault(i, shingle_set(text[i], k))
        out = []
        for i, others, e in _near(pdf, floor):
            for j in others[np.argsort(-e, kind="stable")]:
                x, y = find(comp[i]), find(comp[j])
                if x != y and _linked(of(i), of(j), percent):
                    out.append((ids[j], ids[i]))
                    root[max(x, y)] = min(x, y)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    met = left.join(wanted, [*tile, "visits", "id"]).join(texts, "id")
    links = cut(met.groupBy(*tile).applyInPandas(decide, "a long, b long"), "links")
    discard(known, left, wanted)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (it is that one).

    Documents link if ``100 * intersection >= percent * union`` of their sets.
    """
    small_batches(docs.sparkSession)
    if not isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError("doc_id has to be a whole number: components are named by their smallest one")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    floor = _floor(percent / 100, bands * rows)
    every = cut(sketches(docs, k, bands, rows), "sketches")
    some = every.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "classes")
    keyed = classes.select("id", F.explode("keys").alias("h"))
    # a table of its own, so that the join can split the rows of a large bucket
    leaders = keyed.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("id", "h").alias("r"), "id")).alias("least")).where("m > 1")
    leaders = cut(leaders.select("h", F.col("least.id").alias("leader")), "heads")
    members = cut(keyed.join(leaders, "h"), "buckets")
    pairs = cut(_leader_pairs(members, classes, floor), "leaders")
    best = pairs.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy(F.col("estimate").desc(), "a"))).where("i = 1")
    links = _verify(best, docs, k, percent)
    components = connected_components(links, "a", "b")
    more = _verify(_apart(pairs.join(best.select("a", "b"), ["a", "b"], "left_anti"), components), docs, k, percent)
    links = links.unionByName(more)
    components = connected_components(links, "a", "b")
    links = links.unionByName(_rest(members, classes, docs, components, k, percent, floor))
    components = connected_components(links, "a", "b")
    found = _with_component(classes.select("set_key", "id"), components).select("set_key", "comp")
    out = every.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")  # one row a set: a class of many copies can be split
    own = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    discard(members, pairs)
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """The documents, all columns as they are, of which one of each component stays: the one with its smallest id; rows repeated with one doc_id and text stay once."""
    (name,) = free(docs, "gone")
    gone = cut(near_duplicates(docs, k, percent, bands, rows).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return _once(docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col(name), "left_anti"), docs)


def _once(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (of ``docs``) with one row of each doc_id and text; only ids that ``docs`` repeats are dealt out."""
    (name,) = free(docs, "again")
    keys = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(name), F.xxhash64("text").alias(f"{name}_t"))
    again = cut(keys.groupBy(name, f"{name}_t").agg(F.count("*").alias(f"{name}_n")).where(F.col(f"{name}_n") > 1).select(name).distinct(), "again")
    n = again.count()
    if not n:
        return rows
    some = F.broadcast(again) if n <= BROADCAST_IDS else again
    single = rows.join(some, F.col("doc_id") == F.col(name), "left_anti")
    return single.unionByName(rows.join(some, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM j JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id
"""
