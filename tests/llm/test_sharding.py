import zlib
from collections import Counter

from .conftest import ODD
from pyspark.sql import functions as F

from matchloom.llm.sharding import Leaf, grown_tree, key_of, shard_documents, shard_of


def test_odd_input(odd, empty):
    rows = shard_documents(odd, grown_tree(8), grown_tree(9)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in ODD)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["doc_id"] == 6}) == 1
    assert shard_documents(empty, grown_tree(8)).count() == 0


def shards(spark, tree, n=20_000):
    return [r["s"] for r in spark.range(n).select(shard_of(tree, key_of(F.col("id"))).alias("s")).collect()]


def test_growth_moves_rows_into_the_new_shard_only(spark):
    for n in (8, 11):
        before, after = shards(spark, grown_tree(n)), shards(spark, grown_tree(n + 1))
        moved = [b for a, b in zip(before, after, strict=True) if a != b]
        assert set(moved) == {n}
        assert abs(len(moved) / len(before) - 1 / (n + 1)) < 0.01
    counts = Counter(shards(spark, grown_tree(8)))
    assert max(counts.values()) < 1.1 * min(counts.values())


def test_weights_confine_movement(spark):
    tree = grown_tree(8)
    heavier = [Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 0 else 1.0) for x in tree]
    before, after = shards(spark, tree), shards(spark, heavier)
    region = {x.shard: x.region for x in tree}
    rack = {x.shard: x.rack for x in tree}
    for a, b in zip(before, after, strict=True):
        if a != b:  # only into the region, the rack or the shard that grew, at the level where the draw changed
            assert region[b] == region[0]
            assert region[a] != region[0] or rack[b] == rack[0]
            assert rack[a] != rack[0] or b == 0
    share = Counter(after)
    assert abs(share[0] / len(after) - 2 / 9) < 0.01


def test_rows_repeated_very_often(documents, monkeypatch):
    from matchloom.llm import sharding

    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = documents([(1, "same")] * 50 + [(i, "x") for i in range(2, 40)])
    rows = shard_documents(docs, grown_tree(8)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({1: 50, **dict.fromkeys(range(2, 40), 1)})
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
