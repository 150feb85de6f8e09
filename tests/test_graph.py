import math

import pytest
from conftest import pairs_of

from matchloom.operators import evaluate, graph, prune

LOG = math.log10(2) ** 2


def weights(a, scheme, **o):
    return {(r["id1"], r["id2"]): r["weight"] for r in graph.weighted(graph.build(a, clean=True, **o), scheme).collect()}


@pytest.mark.parametrize(
    ("scheme", "expected"),
    [
        ("cbs", {(0, 2): 1, (0, 3): 1, (1, 2): 1, (1, 3): 2}),
        ("chi_square", {(0, 2): 2, (0, 3): None, (1, 2): None, (1, 3): None}),
        ("arcs", {(0, 2): 0.25, (0, 3): 0.25, (1, 2): 0.25, (1, 3): 0.5}),
        ("js", {(0, 2): 1, (0, 3): 0.5, (1, 2): 0.5, (1, 3): 1}),
        ("ecbs", {(0, 2): LOG, (0, 3): 0, (1, 2): 0, (1, 3): 0}),
    ],
)
def test_weights(blocks, scheme, expected):
    got = weights(blocks([[0, 1], [2, 3]], [[1], [3]]), scheme)
    assert got == {k: (None if v is None else pytest.approx(v)) for k, v in expected.items()}


def test_ejs(blocks):
    got = weights(blocks([[0, 1], [2, 3]], [[0, 1], [2, 3]]), "ejs")
    assert got == {k: pytest.approx(0.09061905828945654) for k in ((0, 2), (0, 3), (1, 2), (1, 3))}


def test_degrees_of_pairs_that_share_two_blocks(blocks):
    g = graph.build(blocks([[0, 1], [2, 3]], [[0, 1], [2]]), clean=True, min_common=2)
    assert {r["id"]: r["degree"] for r in g.nodes.collect()} == {0: 1, 1: 1, 2: 2, 3: 0}
    assert g.totals.first()["n_edges"] == 2


def test_unknown_weight(blocks):
    with pytest.raises(ValueError):
        graph.weighted(graph.build(blocks([0, 1])), "nope")


def test_weight_edge_pruning(blocks):
    assert pairs_of(prune.weight_edge_pruning(graph.build(blocks([0, 1, 2, 3, 4], [0, 1, 2])))) == {(0, 1), (0, 2), (1, 2)}
    assert pairs_of(prune.weight_edge_pruning(graph.build(blocks([[0, 1], [2, 3]], [[0, 1], [2]]), True))) == {(0, 2), (1, 2)}


def test_cardinality_edge_pruning(blocks):
    assert pairs_of(prune.cardinality_edge_pruning(graph.build(blocks([0, 1, 2, 3, 4], [0, 1, 2])))) == {(0, 1), (0, 2), (1, 2), (0, 3)}
    assert pairs_of(prune.cardinality_edge_pruning(graph.build(blocks([[0, 1], [2, 3]], [[0, 1], [2]]), True))) == {(0, 2), (1, 2), (0, 3)}


def test_weight_node_pruning(blocks):
    dirty = graph.build(blocks([0, 1], [0, 1], [1, 2], [2, 3], [2, 3]))
    assert pairs_of(prune.weight_node_pruning(dirty)) == {(0, 1), (2, 3)}
    clean = graph.build(blocks([[0], [3]], [[0], [3]], [[0], [2]], [[1], [2]], [[1], [2]]), True)
    assert pairs_of(prune.weight_node_pruning(clean)) == {(0, 3), (1, 2)}
    with pytest.raises(ValueError):
        prune.weight_node_pruning(clean, how="xor")


def test_cardinality_node_pruning(blocks):
    dirty = graph.build(blocks([0, 1, 2, 3, 4], [0, 1, 2]))
    assert pairs_of(prune.cardinality_node_pruning(dirty, 4)) == {(0, 1), (0, 2), (0, 3), (0, 4)}
    clean = graph.build(blocks([[0, 1], [2, 3]], [[0, 1], [2]]), True)
    assert pairs_of(prune.cardinality_node_pruning(clean, 3)) == {(0, 2), (0, 3), (1, 2)}
    assert pairs_of(prune.cardinality_node_pruning(dirty, 100)) == set()


def test_quality(spark, blocks, profiles):
    g = graph.build(blocks([[0, 1], [2, 3]], [[0, 1], [2]]), True)
    truth = spark.createDataFrame([(2, 0), (1, 3), (0, 9)], "id1 long, id2 long")
    row = evaluate.pair_quality(g.pairs, truth).first()
    assert (row["found"], row["n_truth"], row["n_candidates"], row["precision"]) == (2, 3, 4, 0.5)
    p = profiles({i: (i // 2, {"a": "x"}) for i in range(4)})
    assert pairs_of(evaluate.per_profile(g.pairs, truth, p), "id", "n_candidates", "n_found") == {(0, 2, 1), (1, 2, 1), (2, 0, 0), (3, 0, 0)}
    empty = evaluate.pair_quality(truth.limit(0), truth.limit(0)).first()
    assert empty["recall"] is None
