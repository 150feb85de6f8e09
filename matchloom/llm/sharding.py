"""Sharding by a weighted hash tree: region, then rack, then shard, by weighted draws.

At each level every child of the node draws ``-ln(u) / weight`` with ``u`` a hash of the child's
name and the key, and the smallest draw wins. A child's draw depends on nothing but its own name and
weight, so a change of weights moves keys only into subtrees that grew and out of subtrees that
shrank. :func:`grown_tree` puts an added shard into a region of its own, so the new shard takes keys
only into itself.

Results for odd input, all tested: a null key draws like any other key (its own marker, ``~null``, which a string id may be, too); a null text
has size 1 and no checksum; repeated rows all appear, with slots of their own; an empty table gives
an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut
from .tables import read

#: Leading hash bits (hex digits x 4) that deal a shard's rows out before they are numbered.
BUCKET_DIGITS = 3
HASH_DIGITS = 13
#: Repeats of one row that are numbered in one go.
COPIES = 10_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def grown_tree(shards: int, base: int = 8, fan: int = 2) -> list[Leaf]:
    """``base`` shards, ``fan`` to a rack and ``fan`` racks to a region; each later shard in a region of its own."""
    first = [Leaf(f"r{i // fan**2}", f"k{i // fan}", i) for i in range(min(shards, base))]
    return first + [Leaf(f"r+{i}", f"k+{i}", i) for i in range(base, shards)]


def _levels(tree: list[Leaf]) -> dict:
    """The tree as nested dictionaries with the weight of each node."""
    out: dict = {}
    for leaf in tree:
        out.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    return out


def _hash(salt: str, key: Column) -> Column:
    """52 bits of md5, which any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}/"), key)), 1, HASH_DIGITS), 16, 10).cast("long")


def _draw(children: dict[str, float], key: Column) -> Column:
    """Position of the child that wins the weighted draw."""
    if len(children) == 1:
        return F.lit(0)
    score = lambda name, w: -F.log((_hash(name, key) + 1) / F.lit(float(2**52 + 1))) / F.lit(float(w))
    return F.array_min(F.array(*[F.struct(score(n, w).alias("s"), F.lit(i).alias("i")) for i, (n, w) in enumerate(children.items())]))["i"]


def _total(node) -> float:
    return sum(map(_total, node.values())) if isinstance(node, dict) else node


def shard_of(tree: list[Leaf], key: Column) -> Column:
    """The shard that ``key`` (a string) descends to."""

    def down(node: dict, path: str) -> Column:
        names = {f"{path}{n}": _total(x) for n, x in node.items()}
        pick, out = _draw(names, key), None
        for i, (name, child) in enumerate(node.items()):
            below = down(child, f"{path}{name}.") if isinstance(child, dict) else F.lit(name)
            out = F.when(pick == i, below) if out is None else out.when(pick == i, below)
        return out if len(node) > 1 else below

    return down(_levels(tree), "").cast("int")


def key_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("~null"))


def shard_documents(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """Each document's shard and its slot there; ``docs`` needs ``doc_id`` and ``text``.

    Texts never leave the scan: rows are 40 bytes when they are shuffled, equal ones already summed up.
    Slots follow (hash of doc_id, doc_id, size, checksum): offsets of 4096 hash ranges a shard, a bounded
    table, and a running count inside a range, so no task holds a shard.
    """
    key = key_of(F.col("doc_id"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        shard_of(tree, key).alias("shard"),
        (shard_of(grown, key) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        _hash("slot", key).alias("h"),
    )
    names = rows.columns
    rows = cut(rows.groupBy(*names).agg(F.count("*").alias("n")), "shards")
    rows = rows.withColumn("bucket", F.shiftright("h", 4 * (HASH_DIGITS - BUCKET_DIGITS)))
    start = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).select("shard", "bucket", F.coalesce(F.sum("m").over(start), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(starts), ["shard", "bucket"])  # at most 4096 rows a shard
    placed = placed.withColumns({"first": F.col("base") + F.col("upto") - F.col("n"), "last": F.col("base") + F.col("upto") - 1})
    if (rows.agg(F.max("n")).first()[0] or 0) > COPIES:  # a row that is there so often is dealt to several tasks
        often = placed.where(F.col("n") > COPIES).withColumn("first", F.explode(F.sequence("first", "last", F.lit(COPIES))))
        often = often.withColumn("last", F.least("last", F.col("first") + (COPIES - 1))).repartition("shard", "first")
        placed = placed.where(F.col("n") <= COPIES).unionByName(often)
    placed = placed.withColumn("slot", F.explode(F.sequence("first", "last")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), grown_tree(8), grown_tree(9))


def _sql_shard(tree: list[Leaf]) -> str:
    def hash_(salt: str) -> str:
        return f"('0x' || substr(md5('{salt}/' || k), 1, {HASH_DIGITS}))::BIGINT"

    def down(node: dict, path: str) -> str:
        below = {n: down(c, f"{path}{n}.") if isinstance(c, dict) else str(n) for n, c in node.items()}
        if len(node) == 1:
            return next(iter(below.values()))
        scores = {n: f"-ln(({hash_(f'{path}{n}')} + 1) / {float(2**52 + 1)!r}) / {float(_total(c))!r}" for n, c in node.items()}
        least = f"least({', '.join(scores.values())})"
        return "CASE " + " ".join(f"WHEN {scores[n]} = {least} THEN {below[n]}" for n in node) + " END"

    return down(_levels(tree), "")


#: A checksum table from its polynomial, as the standard of 1986 (reflected 0xEDB88320) has it.
_CRC_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"

OP1_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, {_CRC_STEP.format(c="c")}, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
keyed AS (SELECT *, coalesce(doc_id::VARCHAR, '~null') AS k FROM documents),
rows_ AS (SELECT doc_id, k, coalesce(strlen(text), 0) + 1 AS size,
  CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) END AS text_crc32,
  {_sql_shard(grown_tree(8))} AS shard, {_sql_shard(grown_tree(9))} AS grown_shard,
  ('0x' || substr(md5('slot/' || k), 1, {HASH_DIGITS}))::BIGINT AS h FROM keyed, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM rows_
"""
