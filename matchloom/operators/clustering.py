"""Entity clusters from scored edges (id1, id2, weight): (cluster_id, profile_id), every profile in one cluster.

A cluster's id is its smallest member. Greedy methods (:mod:`greedy`) and Markov clustering (:mod:`flow`) are rounds of
joins and take components of any size. Ricochet and cut clustering run inside a component, in one Python call each. Ricochet refuses one of
more than ``MAX_EDGES`` edges by name before any work is done, which calls for a higher threshold or another method; cuts are local and take any.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from . import flow, greedy
from .components import connected_components


def with_singletons(clusters: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles that no cluster has become clusters of one."""
    alone = profiles.select(F.col("id").alias("profile_id")).join(clusters, "profile_id", "left_anti")
    return clusters.select("cluster_id", "profile_id").unionByName(alone.select(F.col("profile_id").alias("cluster_id"), "profile_id"))


def component_clusters(edges: DataFrame, profiles: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Components of the edges of at least ``threshold``."""
    found = connected_components(edges.where(F.col("weight") >= threshold))
    return with_singletons(found.select(F.col("component").alias("cluster_id"), F.col("node").alias("profile_id")), profiles)


Edges = list[tuple[int, int, float]]
#: Edges of a component that a Python call takes: about 1 GB of a worker's memory. Cuts have no such limit, at about 150 bytes an edge.
MAX_EDGES = {"ricochet": 5_000_000}


def ricochet(edges: Edges) -> dict[int, int]:
    """Heaviest nodes first become centres of the neighbours that are closer to them than to their own centre; clusters of one join their nearest centre."""
    near: dict[int, dict[int, float]] = {}
    for u, v, w in edges:
        near.setdefault(u, {})[v] = w
        near.setdefault(v, {})[u] = w
    heavy = sorted(near, key=lambda x: (-(sum(near[x].values()) / len(near[x]) + 1e-5 * len(near[x])), x))
    of: dict[int, int] = {}
    sim: dict[int, float] = {}
    members: dict[int, set[int]] = {}
    for c in heavy:
        if c in members:
            continue
        mine = {v for v, w in near[c].items() if v not in members and (v not in of or w > sim[v])}
        if not mine:
            continue
        shrunk = set()
        for v in {c, *mine}:
            if v in of:
                members[of[v]].discard(v)
                shrunk.add(of[v])
            of[v], sim[v] = c, 1.0 if v == c else near[c][v]
        members[c] = {c, *mine}
        for old in sorted(shrunk - {c}):
            if old in members and len(members[old]) < 2:
                best = max(((w, -v) for v, w in near[old].items() if v in members and v != old), default=None)
                if best is None:
                    continue
                for x in members.pop(old):
                    of[x], sim[x] = -best[1], near[x].get(-best[1], 0.0)
                    members[-best[1]].add(x)
    for x in near:
        of.setdefault(x, x)
    return of


class _Flows:
    """Least cuts of single nodes from a sink that every node of the graph reaches with capacity ``alpha``.

    A node's flow goes to the nearest nodes whose way to the sink has room left, layer by layer (Dinic), so it looks at no more
    nodes than it fills, and their edges; what it has changed is put back before the next one. Arcs are arrays: 40 bytes for each direction of an edge.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, alpha: float):
        pair, at = np.unique(np.minimum(u, v) * n + np.maximum(u, v), return_inverse=True)
        u, v, w, m = pair // n, pair % n, np.bincount(at, w, len(pair)), len(pair)
        tail, order = np.concatenate([u, v]), np.argsort(np.concatenate([u, v]), kind="stable")
        where = np.empty(2 * m, dtype=np.int64)
        where[order] = np.arange(2 * m)
        self.head, self.full, self.back = np.concatenate([v, u])[order], np.concatenate([w, w])[order], where[(order + m) % (2 * m)]
        self.start = np.searchsorted(tail[order], np.arange(n + 1))
        self.room, self.left, self.level, self.alpha = self.full.copy(), np.full(n, alpha), np.full(n, -1), alpha

    def _arcs(self, nodes: np.ndarray) -> np.ndarray:
        low, n = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())

    def _layers(self, s: int) -> tuple[list[np.ndarray], bool]:
        """Nodes by their distance from ``s`` where room is left, as far as the first layer with a way to the sink; whether there is one."""
        layers = [np.array([s])]
        self.level[s] = 0
        while len(layers[-1]):
            arcs = self._arcs(layers[-1])
            near = self.head[arcs[self.room[arcs] > ROOM]]
            near = np.unique(near[self.level[near] < 0])
            self.level[near] = len(layers)
            layers.append(near)
            if (self.left[near] > ROOM).any():
                return layers, True
        return layers, False

    def _sent(self, x: int, amount: float, depth: int) -> float:
        """How much of ``amount`` gets from ``x`` to the sink through the next layers."""
        if x not in self.ahead:
            arcs = np.arange(self.start[x], self.start[x + 1])
            self.ahead[x] = [arcs[(self.room[arcs] > ROOM) & (self.level[self.head[arcs]] == depth + 1)], 0]
        arcs, k = self.ahead[x]
        if depth + 1 == self.last:
            take = np.minimum(self.room[arcs], self.left[self.head[arcs]])
            take = np.clip(amount - (np.cumsum(take) - take), 0.0, take)
            some = take > 0
            arcs, take = arcs[some], take[some]
            self.left[self.head[arcs]] -= take
            self._moved(arcs, take)
            return float(take.sum())
        done = 0.0
        while k < len(arcs):
            got = self._sent(int(self.head[arcs[k]]), min(amount - done, float(self.room[arcs[k]])), depth + 1)
            if got:
                self._moved(arcs[k : k + 1], got)
                done += got
            if amount - done <= ROOM:
                break
            k += 1
        self.ahead[x][1] = k
        return done

    def _moved(self, arcs: np.ndarray, amount) -> None:
        self.room[arcs] -= amount
        self.room[self.back[arcs]] += amount
        self.changed.append(arcs)

    def side(self, s: int) -> np.ndarray:
        """The nodes on the side of ``s`` of its smallest least cut from the sink."""
        self.changed, drained = [], []
        self.left[s] = 0.0
        while True:
            layers, more = self._layers(s)
            seen = np.concatenate(layers)
            drained.append(seen)
            if more:
                self.ahead, self.last = {}, len(layers) - 1
                self._sent(s, float("inf"), 0)
            self.level[seen] = -1
            if not more:
                break
        arcs, nodes = np.concatenate([np.empty(0, dtype=np.int64), *self.changed]), np.concatenate(drained)
        for x in (arcs, self.back[arcs]):
            self.room[x] = self.full[x]
        self.left[nodes] = self.alpha
        return seen


#: What is no more than this is no room: sums of doubles depend on their order.
ROOM = 1e-12


def cut_clusters(a: np.ndarray, b: np.ndarray, weights: np.ndarray, alpha: float = 0.3) -> dict[int, int]:
    """:func:`cut_tree` of edges in arrays.

    The tree hangs each node on the sink first, and in order of ids each moves what is on its side of a least cut, and comes later. Cuts between a node and the one
    that it hangs on move nodes within what hangs together without the sink, so only cuts from the sink are looked for, of nodes that still hang on it.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    of, flows = np.full(len(ids), -1), _Flows(at[: len(a)], at[len(a) :], weights, len(ids), alpha)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + len(ids))  # a layer is a call
    for s in range(len(ids)):
        if of[s] < 0:
            side = flows.side(s)
            of[side[(side >= s) & (of[side] < 0)]] = s
    sys.setrecursionlimit(limit)
    return dict(zip(ids.tolist(), ids[of].tolist(), strict=True))


def cut_tree(edges: Edges, alpha: float = 0.3) -> dict[int, int]:
    """Minimum cut tree of the graph with a sink that every node reaches with capacity ``alpha``; clusters hang together without the sink."""
    u, v, w = zip(*edges, strict=True)
    return cut_clusters(np.array(u), np.array(v), np.array(w, dtype="float64"), alpha)


#: Methods that run in one Python call a component, on its edges (id1, id2, weight), the heaviest first.
WHOLE: dict[str, Callable[[pd.DataFrame], dict[int, int]]] = {
    "ricochet": lambda e: ricochet(list(zip(e["id1"].tolist(), e["id2"].tolist(), e["weight"].tolist(), strict=True))),
    "cut": lambda e: cut_clusters(e["id1"].to_numpy(), e["id2"].to_numpy(), e["weight"].to_numpy()),
}


def _by_component(used: DataFrame, method: str) -> DataFrame:
    fn = WHOLE[method]
    components = connected_components(used)
    rows = cut(used.join(components.select(F.col("node").alias("id1"), "component"), "id1"), "edges")
    large = method in MAX_EDGES and rows.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "component")).alias("most")).first()["most"]
    if large and large["n"] > MAX_EDGES[method]:
        raise ValueError(f"component {large['component']} has {large['n']} edges, {method} takes {MAX_EDGES[method]}: raise the threshold")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "id1", "id2"], ascending=[False, True, True])
        of = fn(pdf)
        least: dict[int, int] = {}
        for x, c in of.items():
            least[c] = min(least.get(c, x), x)
        return pd.DataFrame({"cluster_id": [least[c] for c in of.values()], "profile_id": list(of)}, dtype="int64")

    return rows.groupBy("component").applyInPandas(run, "cluster_id long, profile_id long")


METHODS = ("center", "merge_center", "unique_mapping", "markov", *WHOLE)


def cluster(edges: DataFrame, profiles: DataFrame, method: str, threshold: float = 0.0) -> DataFrame:
    """Clusters of the edges above ``threshold`` by one of ``METHODS``."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}; one of {METHODS}")
    used = edges.where(F.col("weight") > threshold).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), F.col("weight").cast("double").alias("weight"))
    used = cut(used, "edges")
    if method == "markov":
        found = flow.markov(used)
    else:
        found = greedy.METHODS[method](used) if method in greedy.METHODS else _by_component(used, method)
    return with_singletons(found, profiles)
