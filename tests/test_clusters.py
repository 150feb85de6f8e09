import random

import numpy as np
import pytest
from conftest import pairs_of

from matchloom.operators import clustering, evaluate, flow, greedy
from matchloom.operators.components import connected_components

EDGES = [(0, 6, 0.8), (1, 4, 0.9), (2, 9, 0.7), (2, 7, 0.6), (4, 8, 0.6), (7, 9, 0.9)]


@pytest.fixture
def graph(spark, profiles):
    return spark.createDataFrame(EDGES, "id1 long, id2 long, weight double"), profiles({i: (i % 2, {"a": "x"}) for i in range(10)})


def sets(clusters):
    out = {}
    for c, p in pairs_of(clusters, "cluster_id", "profile_id"):
        out.setdefault(c, set()).add(p)
    assert all(c == min(m) for c, m in out.items())
    return sorted(map(sorted, out.values()))


def test_components(graph):
    assert sets(clustering.component_clusters(*graph, 0.5)) == [[0, 6], [1, 4, 8], [2, 7, 9], [3], [5]]
    assert sets(clustering.component_clusters(*graph, 0.9)) == [[0], [1, 4], [2], [3], [5], [6], [7, 9], [8]]
    assert sets(clustering.component_clusters(graph[0].limit(0), graph[1], 0.5)) == [[i] for i in range(10)]


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "id1 long, id2 long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize(
    ("method", "expected"),
    [
        ("center", [[0, 6], [1, 4], [2], [3], [5], [7, 9], [8]]),
        ("merge_center", [[0, 6], [1, 4], [2, 7, 9], [3], [5], [8]]),
        ("unique_mapping", [[0, 6], [1, 4], [2], [3], [5], [7, 9], [8]]),
    ],
)
def test_greedy_methods(graph, method, expected):
    got = sets(clustering.cluster(*graph, method, 0.5))
    assert sorted(x for c in got for x in c) == list(range(10))
    if method != "center":
        assert got == expected


@pytest.mark.parametrize("method", sorted(clustering.METHODS))
def test_every_profile_is_in_one_cluster_within_its_component(graph, method):
    components = [set(c) for c in sets(clustering.component_clusters(*graph, 0.5))]
    got = sets(clustering.cluster(*graph, method, 0.5))
    assert sorted(x for c in got for x in c) == list(range(10))
    assert all(any(set(c) <= k for k in components) for c in got)


CLIQUES = [(a, b, 1.0) for ids in (range(4), range(4, 8)) for a in ids for b in ids if a < b] + [(3, 4, 0.01)]


def test_cut_splits_weak_bridges():
    of = clustering.cut_tree(sorted(CLIQUES, key=lambda e: -e[2]), 0.3)
    assert {of[i] for i in range(4)} == {of[0]}
    assert {of[i] for i in range(4, 8)} == {of[4]}
    assert of[0] != of[4]


def dense_markov(edges, rounds, least=1e-3):
    """The same flow in a matrix, with components by search."""
    n = 1 + max(b for _, b, _ in edges)
    m = np.eye(n)
    for a, b, w in edges:
        m[a, b] = w
    m = m / m.sum(axis=0)
    for _ in range(rounds):
        m = (m @ m) ** 2
        m = m / m.sum(axis=0)
    of, linked = list(range(n)), (m > least) | (m > least).T
    for _ in range(n):
        of = [min(of[j] for j in range(n) if linked[i, j] or i == j) for i in range(n)]
    return of


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_markov_against_a_dense_matrix(spark, rounds):
    r = random.Random(rounds)
    edges = CLIQUES + [(a, b, round(r.random(), 3)) for a in range(8, 40) for b in range(a + 1, 40) if r.random() < 0.06] + [(40, b, 0.9) for b in range(41, 90)]
    rows = flow.markov(spark.createDataFrame(edges, "id1 long, id2 long, weight double"), rounds=rounds, epsilon=0.0)
    got = {x["profile_id"]: x["cluster_id"] for x in rows.collect()}
    want = dense_markov(edges, rounds)
    assert got == {i: want[i] for i in {x for e in edges for x in e[:2]}}


def test_cluster_quality(spark, graph):
    clusters = clustering.component_clusters(*graph, 0.5)
    truth = spark.createDataFrame([(6, 0), (1, 8), (3, 5)], "id1 long, id2 long")
    row = evaluate.cluster_quality(clusters, truth).first()
    assert (row["found"], row["n_truth"], row["n_candidates"]) == (2, 3, 7)
    assert evaluate.cluster_pairs(clusters).count() == 7
    across = evaluate.cluster_quality(clusters, truth, graph[1]).first()
    assert (across["found"], across["n_candidates"]) == (1, evaluate.cluster_pairs(clusters, graph[1]).count())


def brute_force(method, edges):
    """Each method as its rule reads, over lists that are searched from the start each time."""
    if method == "unique_mapping":
        pairs = []
        for u, v, _ in edges:
            if not any(x in p for p in pairs for x in (u, v)):
                pairs.append((u, v))
        return [set(p) for p in pairs]
    clusters = []  # (centre, members)
    mean = {x: sum(w for u, v, w in edges if x in (u, v)) / sum(x in (u, v) for u, v, _ in edges) for e in edges for x in e[:2]}
    where = lambda x: next((c for c in clusters if x in c[1]), None)
    for u, v, _ in edges:
        a, b = where(u), where(v)
        if a is None and b is None:
            centre = u if method == "merge_center" or mean[u] > mean[v] + 1e-12 else v
            clusters.append([{centre}, {u, v}])
        elif b is None and u in a[0]:
            a[1].add(v)
        elif a is None and b is not None and v in b[0]:
            b[1].add(u)
        elif method == "merge_center" and a is not None and b is not None and a is not b and (u in a[0]) != (v in b[0]):
            a[0].update(b[0])
            a[1].update(b[1])
            clusters.remove(b)
    return [c[1] for c in clusters]


@pytest.mark.parametrize("method", sorted(greedy.METHODS))
def test_greedy_methods_against_brute_force(spark, method):
    """Two hundred small graphs, a long path whose weights fall, a star, a clique of equal weights: all in one table, since components don't touch."""
    r = random.Random(11)
    graphs = []
    for _ in range(200):
        n = r.randint(2, 14)
        graphs.append([(a, b, round(r.random(), r.randint(1, 3))) for a in range(n) for b in range(a + 1, n) if r.random() < 0.35])
    graphs += [[(i, i + 1, 1 - i / 100) for i in range(12)], [(0, i, i / 100) for i in range(1, 80)], [(a, b, 1.0) for a in range(12) for b in range(a + 1, 12)]]
    rows, want = [], []
    for k, g in enumerate(graphs):
        g = sorted(((a + 100 * k, b + 100 * k, w) for a, b, w in g), key=lambda e: (-e[2], e[0], e[1]))
        rows += g
        want += [sorted(c) for c in brute_force(method, g)]
    r.shuffle(rows)
    got = greedy.METHODS[method](spark.createDataFrame(rows, "id1 long, id2 long, weight double").repartition(3))
    assert sets(got) == sorted(want)


@pytest.mark.parametrize("whole", [200_000, 50])
def test_equal_weights_take_few_rounds(spark, monkeypatch, whole):
    """A clique of equal weights needs a round for every two nodes; what is left of it is decided in one call once it is small enough."""
    tags, written = [], greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df, tag="cut": (tags.append(tag), written(df, tag))[1])
    monkeypatch.setattr(greedy, "WHOLE", whole, raising=False)
    edges = [(a, b, 0.7) for a in range(24) for b in range(a + 1, 24)] + [(100, 101, 0.9), (101, 102, 0.8)]
    got = greedy.unique_mapping(spark.createDataFrame(edges, "id1 long, id2 long, weight double").repartition(3))
    assert sets(got) == sorted([[i, i + 1] for i in range(0, 24, 2)] + [[100, 101]])
    assert tags.count("taken") <= (4 if whole > len(edges) else 12)


def test_no_edges(spark):
    none = spark.createDataFrame([], "id1 long, id2 long, weight double")
    assert all(fn(none).count() == 0 for fn in (*greedy.METHODS.values(), flow.markov))


def test_large_components_are_refused(graph, monkeypatch):
    monkeypatch.setattr(clustering, "MAX_EDGES", {"ricochet": 2, "cut": 2})
    with pytest.raises(ValueError, match="component 2 has 3 edges"):
        clustering.cluster(*graph, "ricochet", 0.5)
    with pytest.raises(ValueError, match="no such method"):
        clustering.cluster(*graph, "other", 0.5)


def test_markov_shuffles_no_partial_sum(spark, monkeypatch):
    """Blocks smaller than components, a hub and a clique across several: as the dense matrix, and each entry of a product is made once."""
    monkeypatch.setattr(flow, "BLOCK", 4)
    r = random.Random(9)
    edges = [(a, b, round(0.5 + r.random() / 2, 3)) for a in range(20) for b in range(a + 1, 20) if r.random() < 0.7] + [(20, b, 0.9) for b in range(21, 40)] + [(a, a + 1, 0.8) for a in range(40, 60)]
    matrix = spark.createDataFrame([(i, j, w, i // 4, j // 4) for i, j, w in edges] + [(i, i, 1.0, i // 4, i // 4) for i in range(61)], "i long, j long, y double, ib long, jb long")
    m = np.eye(61)
    for a, b, w in edges:
        m[a, b] = w
    rows = flow.squared(matrix).collect()
    assert len(rows) == len({(x["i"], x["j"]) for x in rows}) == np.count_nonzero(m @ m)
    assert all(x["y"] == pytest.approx((m @ m)[x["i"], x["j"]]) and (x["ib"], x["jb"]) == (x["i"] // 4, x["j"] // 4) for x in rows)
    assert "HashAggregate(keys=[i#" not in flow.squared(matrix)._jdf.queryExecution().executedPlan().toString()
    found = flow.markov(spark.createDataFrame(edges, "id1 long, id2 long, weight double"), epsilon=0.0)
    want = dense_markov(edges, 2)
    assert {x["profile_id"]: x["cluster_id"] for x in found.collect()} == dict(enumerate(want))


def test_merge_center_of_members_is_that_of_all_pairs(spark):
    """two classes of copies merge, since a centre meets a member of the other; single profiles and ids in any order between."""
    r = random.Random(14)
    pairs, members, want = [], [], []
    for k in range(150):
        at, reps, groups = 100 * k, {}, r.randint(2, 6)
        ids = r.sample(range(40), 40)
        for _ in range(groups):
            own = sorted(ids.pop() + at for _ in range(r.choice([1, 1, 2, 3, 4])))
            reps[own[0]] = own
        near = [(a, b, r.randint(6, 9) / 10) for a in reps for b in reps if a < b and r.random() < 0.4]
        everyone = [(min(x, y), max(x, y), w) for a, b, w in near for x in reps[a] for y in reps[b]]
        everyone += [(x, y, 1.0) for own in reps.values() for x in own for y in own if x < y]
        want += [sorted(c) for c in brute_force("merge_center", sorted(everyone, key=lambda e: (-e[2], e[0], e[1])))]
        pairs += near
        members += [(x, own[0]) for own in reps.values() for x in own]
    got = greedy.merge_center_of_members(spark.createDataFrame(pairs, "id1 long, id2 long, weight double").repartition(3), spark.createDataFrame(members, "id long, rep long"))
    assert sets(got) == sorted(want)


def gomory_hu(edges, alpha):
    """The tree as it reads: a cut between each node and the one that it hangs on, by shortest augmenting paths over all of the graph."""
    ids, sink = sorted({x for u, v, _ in edges for x in (u, v)}), -1
    cap = {x: {} for x in [*ids, sink]}
    for u, v, w in [*edges, *((x, sink, alpha) for x in ids)]:
        cap[u][v] = cap[u].get(v, 0.0) + w
        cap[v][u] = cap[v].get(u, 0.0) + w
    tree = dict.fromkeys(ids, sink)
    for i, s in enumerate(ids):
        left, t = {x: dict(c) for x, c in cap.items()}, tree[s]
        while True:
            parent, queue = {s: s}, [s]
            for x in queue:
                for y, room in left[x].items():
                    if room > 1e-12 and y not in parent:
                        parent[y] = x
                        queue.append(y)
            if t not in parent:
                break
            path = [t]
            while path[-1] != s:
                path.append(parent[path[-1]])
            flow = min(left[b][a] for a, b in zip(path, path[1:], strict=False))
            for a, b in zip(path, path[1:], strict=False):
                left[b][a] -= flow
                left[a][b] += flow
        for x in ids[i + 1 :]:
            if x in parent and tree[x] == t:
                tree[x] = s
    root = lambda x: x if tree[x] == sink else root(tree[x])
    return {x: root(x) for x in ids}


def test_cuts_are_those_of_the_whole_tree():
    r = random.Random(1)
    for _ in range(150):
        n, alpha = r.randint(2, 26), r.choice([0.05, 0.3, 0.3, 1.0])
        edges = [(a, b, 0.5 + r.random() / 2) for a in range(n) for b in range(a + 1, n) if r.random() < r.choice([0.1, 0.3, 0.9])] or [(0, 1, 0.7)]
        names = r.sample(range(1000), n)
        edges = [(min(names[a], names[b]), max(names[a], names[b]), w) for a, b, w in edges]
        assert clustering.cut_tree(edges, alpha) == gomory_hu(edges, alpha)


def test_cut_takes_a_component_of_any_size(spark, profiles):
    """groups of near copies on a chain, 31,609 edges in one component, more than were taken before."""
    edges = [(a, b, 0.8) for k in range(0, 800, 80) for a in range(k, k + 80) for b in range(a + 1, k + 80)] + [(k + 79, k + 80, 0.55) for k in range(0, 720, 80)]
    assert len(edges) == 31_609
    table = spark.createDataFrame(edges, "id1 long, id2 long, weight double")
    got = sets(clustering.cluster(table, profiles({i: (0, {"a": "x"}) for i in range(800)}), "cut", 0.5))
    assert got == [list(range(k, k + 80)) for k in range(0, 800, 80)]
