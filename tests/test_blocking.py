import random

import pytest
from conftest import pairs_of

from matchloom.functions import keys as K
from matchloom.operators import blocking, lsh, refine


def grouped(assignments):
    out = {}
    for r in assignments.collect():
        out.setdefault(r["key"], set()).add(r["profile_id"])
    return sorted(map(sorted, out.values()))


def test_token_blocking_clean(profiles):
    p = profiles({0: (0, {"n": "Tom"}), 1: (1, {"n": "Tom"})})
    assert grouped(blocking.token_blocking(p, clean=True)) == [[0, 1]]
    q = profiles({0: (0, {"n": "Joel"}), 1: (1, {"n": "Tom"})})
    assert grouped(blocking.token_blocking(q, clean=True)) == []
    same = profiles({0: (0, {"n": "Tom"}), 1: (0, {"n": "Tom"})})
    assert grouped(blocking.token_blocking(same, clean=True)) == []
    assert grouped(blocking.token_blocking(same)) == [[0, 1]]


def test_sizes(blocks):
    a = blocks([[0, 1], [2, 3], [4]])
    assert blocking.sizes(a, clean=True).first()["comparisons"] == 8
    assert blocking.sizes(a).first()["comparisons"] == 20


@pytest.mark.parametrize(("window", "expected"), [(1, []), (2, [[0, 1], [0, 3]]), (3, [[0, 1, 3], [0, 2, 3]]), (4, [[0, 1, 2, 3]])])
def test_sorted_neighbourhood(profiles, window, expected):
    p = profiles({0: (0, {"n": "Tom"}), 1: (1, {"n": "Tom"}), 2: (1, {"n": "Joel"}), 3: (1, {"n": "Joel"})})
    assert grouped(blocking.sorted_neighbourhood(p, window, clean=True)) == expected


def test_sorted_neighbourhood_needs_a_window(profiles):
    with pytest.raises(ValueError):
        blocking.sorted_neighbourhood(profiles({0: (0, {"n": "x"})}), 0)


def test_schema_aware_blocking(spark, profiles):
    p = profiles({0: (0, {"name": "x", "other": "y"}), 1: (1, {"label": "x y"}), 2: (1, {"odd": "y"})})
    clusters = spark.createDataFrame([(0, 0, "name", 1.0), (0, 1, "label", 1.0), (1, 0, "-", 0.0)], "cluster_id int, source_id int, attribute string, entropy double")
    rows = {(r["key"], r["profile_id"]) for r in blocking.schema_aware_blocking(p, clusters).collect()}
    assert rows == {("x_0", 0), ("x_0", 1), ("y_1", 0), ("y_1", 2)}
    assert {r["key"] for r in blocking.schema_aware_blocking(p, clusters, drop_default=True).collect()} == {"x_0"}


def test_schema_aware_keys_are_made_within_the_row(spark, profiles, monkeypatch):
    """Keys of an attribute that is alone in its cluster are not dealt out to be made distinct; those of several attributes are joined."""
    plans, written = {}, blocking.cut

    def seen(df, tag="cut"):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(blocking, "cut", seen)
    p = profiles({0: (0, {"name": "x x y", "nick": "x", "other": "q"}), 1: (1, {"label": "X-y", "odd": ["q", "q r"]}), 2: (1, {"odd": "", "label": "z"}), 3: (0, {"more": "q r", "other": "r"})})
    clusters = spark.createDataFrame([(0, 0, "name", 1.0), (0, 0, "nick", 1.0), (0, 1, "label", 1.0), (1, 0, "-", 0.5)], "cluster_id int, source_id int, attribute string, entropy double")
    rows = {(r["key"], r["profile_id"], r["cluster_id"], r["entropy"], tuple(r["attributes"])) for r in blocking.schema_aware_blocking(p, clusters).collect()}
    assert rows == {
        ("x_0", 0, 0, 1.0, ("name", "nick")), ("y_0", 0, 0, 1.0, ("name",)), ("x_0", 1, 0, 1.0, ("label",)), ("y_0", 1, 0, 1.0, ("label",)),
        ("q_1", 0, 1, 0.5, ("other",)), ("q_1", 1, 1, 0.5, ("odd",)), ("r_1", 1, 1, 0.5, ("odd",)), ("q_1", 3, 1, 0.5, ("more",)), ("r_1", 3, 1, 0.5, ("more", "other")),
    }
    assert "hashpartitioning(key" not in plans.get("parts", plans.get("keyed"))


def test_purging(blocks):
    a = blocks([[0], [4]], [[0, 1], [4]], [[0, 1], [4]], [[0, 1, 2], [4]], [[0, 1, 2], [4]], [[0, 1, 2, 3], [4, 5, 6, 7]])
    assert {r["key"] for r in refine.purge(a, 1.0, clean=True).collect()} == {"b000", "b001", "b002"}


def test_one_level_is_purged_unless_kept(blocks):
    a = blocks([0, 1], [2, 3])
    assert refine.purge(a).count() == 0
    assert refine.purge(a, keep_single_level=True).count() == 4


def test_levels(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("b", 2, 4), ("c", 4, 4)], "key string, size long, comparisons long")
    assert [tuple(r) for r in refine.levels(rows).orderBy("level").collect()] == [(1, 1, 2), (4, 9, 8)]


def test_filtering(blocks):
    a = blocks([[0], [1]], [[0], [1, 2]], [[0], [1, 2, 3]], [[0], [1, 2, 3, 4]], [[0], [1, 2, 3, 4, 5]])
    kept = refine._ranked(a, 0.8, True, 0).where("rank <= keep").groupBy("profile_id").count().collect()
    assert {r["profile_id"]: r["count"] for r in kept} == {0: 4, 1: 4, 2: 3, 3: 2, 4: 2, 5: 1}
    assert refine.filter_blocks(a, 0.0, True).count() == 0
    assert refine.filter_blocks(a, 1.0, True).count() == a.count()


def test_filtering_with_ties(blocks):
    a = blocks(*[[[0], [1]]] * 5)
    assert refine.filter_blocks_with_ties(a, 0.1, True).count() == 10
    with pytest.raises(ValueError):
        refine.filter_blocks_with_ties(a, 0.0, True)


def test_band_tuning(spark):
    assert [lsh.bands(t, 128) for t in (1.0, 0.8, 0)] == [2, 12, 129]
    assert lsh.rows_per_band(0.8, 128) == 10
    thresholds = [0.0, 0.1, 0.35, 0.5, 0.8, 1.0]
    got = lsh.bands_of(spark.createDataFrame([(t,) for t in thresholds * 2], "threshold double"), 128).collect()
    assert {tuple(r) for r in got} == {(t, lsh.bands(t, 128), lsh.rows_per_band(t, 128)) for t in thresholds} and len(got) == len(thresholds)


def test_minhash_blocks(profiles):
    p = profiles({0: (0, {"name": "apple0"}), 1: (1, {"label": "apple0"}), 2: (1, {"label": "pear"})})
    assert grouped(lsh.minhash_blocking(p, 4, 0.5, clean=True)) == [[0, 1]] * -(-4 // lsh.rows_per_band(0.5, 4))


def test_attribute_clusters(profiles):
    apples = [f"apple{i}" for i in range(10)]
    p = profiles({0: (0, {"name": apples, "bar": "banana0"}), 1: (1, {"label": apples, "bar": "cat0"})})
    rows = pairs_of(lsh.cluster_attributes(p, 0.5), "cluster_id", "source_id", "attribute")
    assert rows == {(0, 0, "name"), (0, 1, "label"), (1, 0, "bar"), (1, 1, "bar")}
    q = profiles({0: (0, {"name": apples, "bar": "banana0"}), 1: (1, {"label": "apple0", "bar": "cat0"})})
    assert {r["cluster_id"] for r in lsh.cluster_attributes(q, 0.5).collect()} == {0}


def test_sketches_find_what_the_exact_join_finds(spark, monkeypatch):
    """10,000 attributes of two sources, in families of similar ones: recall of pairs above the threshold, and nothing that the exact join doesn't have."""
    from matchloom.operators import graph

    r = random.Random(13)
    rows = []
    for family in range(2_000):
        own = [f"t{family}_{i}" for i in range(12)]
        for k in range(5):
            tokens = [t for t in own if r.random() > 0.05 * k] + [f"x{family}_{k}"]
            rows += [(k % 2, f"f{family}_{k}", t, 1) for t in tokens]
    tokens = spark.createDataFrame(rows, "source_id int, attribute string, token string, n long")
    exact = {(x["a"], x["b"]): x["similarity"] for x in lsh.attribute_similarity(tokens).collect()}
    monkeypatch.setattr(graph, "TILE", 3)  # buckets are dealt to tiles
    sketched = {(x["a"], x["b"]): x["similarity"] for x in lsh.attribute_similarity(tokens, sketch=(64, 0.5)).collect()}
    assert all(exact[p] == s for p, s in sketched.items())
    similar = {p for p, s in exact.items() if s >= 0.7}
    assert len(similar) > 5_000
    assert len(similar & set(sketched)) >= 0.95 * len(similar)


def test_attribute_clusters_by_sketch(profiles):
    apples = [f"apple{i}" for i in range(10)]
    p = profiles({0: (0, {"name": apples, "bar": "banana0"}), 1: (1, {"label": apples, "bar": "cat0"})})
    rows = pairs_of(lsh.cluster_attributes(p, 0.5, sketch=(128, 0.5)), "cluster_id", "source_id", "attribute")
    assert rows == {(0, 0, "name"), (0, 1, "label"), (1, 0, "bar"), (1, 1, "bar")}


def test_signature_similarity(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(lsh.signature_similarity(F.array(*map(F.lit, range(4))), F.array(*map(F.lit, (0, 1, 9, 3)))).alias("s"), lsh.signature_similarity(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("n")).first()
    assert row["s"] == 0.75
    assert row["n"] is None


def test_keys_are_pluggable(profiles):
    p = profiles({0: (0, {"n": "tommy"}), 1: (0, {"n": "jommy"})})
    assert grouped(blocking.token_blocking(p, make_keys=K.suffixes)) == [[0, 1]] * 3
