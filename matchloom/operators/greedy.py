"""Greedy clusterings of weighted edges, decided in parallel rounds.

The sequential rule visits edges from the heaviest on (ties by ids) and looks at nothing but the states of an edge's ends. So an
edge can be decided as soon as no undecided edge before it touches one of its ends, and that holds for many edges at once:
each round every node names the first of its undecided edges, and an edge that is named by all of its free ends is decided. The
heaviest edge of any component always is, so rounds end, with the result of the sequential order. An edge that can't
change anything any more (a taken end) leaves at once, and so do all edges around it. Where weights fall along a long path, or are equal
all over a group, rounds would be many: every few rounds, what still hangs together and is small enough is decided in one call, edge by edge.

Edges (id1, id2, weight) have id1 < id2, once each. All functions return (cluster_id, profile_id) for the nodes that
a rule has taken; a cluster's id is its smallest member.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard
from .components import connected_components
from .ranking import with_position

#: States of a node that is taken; one without a state is free.
CENTRE, MEMBER = 1, 2
#: Means that differ by no more are equal: sums of doubles depend on their order.
EQUAL = 1e-12
#: Rounds before what is left is looked through for components, and edges of one that a call takes.
ROUNDS, WHOLE = 4, 200_000


def _named(clusters: DataFrame) -> DataFrame:
    """(cluster_id, profile_id) from (c, x), any name of a cluster and a member."""
    least = clusters.groupBy("c").agg(F.min("x").alias("cluster_id"))
    return clusters.join(least, "c").select("cluster_id", F.col("x").alias("profile_id"))


def _in_order(edges: pd.DataFrame, pairs_only: bool) -> pd.DataFrame:
    """The sequential rule over whole components (id1, id2, c, w, s1, s2)."""
    edges, state, out = edges.sort_values(["w", "id1", "id2"]), {}, []
    for a, b, c, w, s1, s2 in zip(*(edges[x].tolist() for x in ("id1", "id2", "c", "w", "s1", "s2")), strict=True):
        s1, s2 = state.get(a, s1), state.get(b, s2)
        if (s1 and s2) or MEMBER in (s1, s2) or (pairs_only and (s1 or s2)):
            continue
        centre = a if s1 == CENTRE else b if s2 == CENTRE else c
        for x, before in ((a, s1), (b, s2)):
            if not before:
                state[x] = CENTRE if x == centre else MEMBER
                out.append((x, state[x], centre, w, a, b))
    return pd.DataFrame(out, columns=["x", "state", "of", "w", "id1", "id2"])


def _whole(edges: DataFrame, pairs_only: bool) -> tuple[DataFrame, DataFrame]:
    """What the rule takes in components of up to ``WHOLE`` undecided edges, and the edges of larger ones.

    A centre stays what it is, so components hang together by free nodes only, and no edge of one looks at another's.
    """
    found = connected_components(edges.where("s1 = 0 and s2 = 0")).withColumnRenamed("node", "home")
    home = F.when(F.col("s1") == 0, F.col("id1")).otherwise(F.col("id2"))
    rows = cut(edges.withColumn("home", home).join(found, "home", "left").withColumn("component", F.coalesce("component", "home")).drop("home"), "hanging")
    large = cut(rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("component"), "large")
    small = rows.join(large, "component", "left_anti")
    buckets = max(8 * edges.sparkSession.sparkContext.defaultParallelism, 4 * rows.count() // WHOLE)
    flat = small.select(F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket"), "id1", "id2", "c", "k.w", "s1", "s2")
    kind = edges.schema["id1"].dataType.simpleString()
    done = flat.groupBy("bucket").applyInPandas(lambda pdf: _in_order(pdf.drop(columns="bucket"), pairs_only), f"x {kind}, state int, of {kind}, w double, id1 {kind}, id2 {kind}")
    taken = cut(done.select("x", "state", "of", F.struct("w", "id1", "id2").alias("at")), "taken")
    rest = cut(rows.join(large, "component", "left_semi").select("id1", "id2", "c", "k", "s1", "s2"), "greedy")
    discard(rows, large)
    return taken, rest


def _decide(edges: DataFrame, pairs_only: bool = False) -> DataFrame:
    """(x, state, of, at): how the rule takes nodes. ``edges`` has ``c``, the end that becomes the centre where both are free.

    ``of`` is the node's centre, ``at`` the order key of the edge that took it. With ``pairs_only`` a taken node takes no others.
    """
    free = F.lit(0)
    now = cut(edges.select("id1", "id2", "c", F.struct((-F.col("weight")).alias("w"), "id1", "id2").alias("k"), free.alias("s1"), free.alias("s2")), "greedy")
    taken, rounds = [], 0
    while now.limit(1).count():
        rounds += 1
        if rounds % ROUNDS == 0:
            new, rest = _whole(now, pairs_only)
            taken.append(new)
            discard(now)
            now = rest
            continue
        ends = [F.when(F.col(f"s{i}") == 0, F.struct(F.col(f"id{i}").alias("x"), F.struct("k", "c", "s1", "s2").alias("e"))) for i in (1, 2)]
        first = now.select(F.explode(F.array_compact(F.array(*ends))).alias("v")).groupBy("v.x").agg(F.min("v.e").alias("e"))
        chosen = first.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") == (F.col("e.s1") == 0).cast("int") + (F.col("e.s2") == 0).cast("int"))
        a, b = F.col("e.k.id1"), F.col("e.k.id2")
        centre = F.when(F.col("e.s1") == CENTRE, a).when(F.col("e.s2") == CENTRE, b).otherwise(F.col("e.c"))
        rows = [F.when(F.col(f"e.s{i}") == 0, F.struct(x.alias("x"), F.when(centre == x, CENTRE).otherwise(MEMBER).alias("state"), centre.alias("of"), F.col("e.k").alias("at"))) for i, x in ((1, a), (2, b))]
        new = cut(chosen.select(F.explode(F.array_compact(F.array(*rows))).alias("t")).select("t.*"), "taken")
        taken.append(new)
        before = now
        for i in (1, 2):
            s = new.select(F.col("x").alias(f"id{i}"), F.col("state").alias(f"n{i}"))
            now = now.join(s, f"id{i}", "left").withColumn(f"s{i}", F.coalesce(f"n{i}", f"s{i}")).drop(f"n{i}")
        # an edge with a member, or with two taken ends, changes nothing
        open_ = F.col("s1") + F.col("s2") == 0 if pairs_only else ((F.col("s1") == 0) | (F.col("s2") == 0)) & (F.col("s1") != MEMBER) & (F.col("s2") != MEMBER)
        after = cut(now.where(open_).select("id1", "id2", "c", "k", "s1", "s2"), "greedy")
        discard(before)
        now = after
    if not taken:
        return edges.select(F.col("id1").alias("x"), F.lit(CENTRE).alias("state"), F.col("c").alias("of"), F.struct((-F.col("weight")).alias("w"), "id1", "id2").alias("at")).limit(0)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    out = cut(out, "decided")
    discard(*taken)
    return out


def center(edges: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Heaviest edges first: of two free nodes the one with the larger mean weight (the second, if equal to ``EQUAL``) becomes a centre, and centres take free nodes.

    ``means`` (x, mean) has the mean weights where ``edges`` stand for more of them.
    """
    sums = edges.select(F.explode(F.array("id1", "id2")).alias("x"), "weight").groupBy("x").agg(F.avg("weight").alias("mean")) if means is None else means
    for i in (1, 2):
        edges = edges.join(sums.select(F.col("x").alias(f"id{i}"), F.col("mean").alias(f"m{i}")), f"id{i}")
    taken = _decide(edges.select("id1", "id2", "weight", F.when(F.col("m1") > F.col("m2") + EQUAL, F.col("id1")).otherwise(F.col("id2")).alias("c")))
    return _named(taken.select("x", F.col("of").alias("c")))


def _placed(members: DataFrame) -> DataFrame:
    """(rep, id, place, n): each member's place (from 0, by id) in its class, and the size of the class."""
    rows = cut(with_position(members.select("rep", "id"), ["rep", "id"]), "placed")
    own = rows.groupBy("rep").agg(F.min("position").alias("start"), F.count("*").alias("n"))
    return cut(rows.join(own, "rep").select("rep", "id", (F.col("position") - F.col("start")).alias("place"), "n"), "places")


def _between(pairs: DataFrame, ends: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Edges of the classes' ``ends`` (rep, id): the pairs of representatives of which both have one; those of id2 from ``others``, if given."""
    for i, x in ((1, ends), (2, ends if others is None else others)):
        pairs = pairs.join(x.select(F.col("rep").alias(f"id{i}"), F.col("id").alias(f"e{i}")), f"id{i}")
    return pairs.select(F.least("e1", "e2").alias("id1"), F.greatest("e1", "e2").alias("id2"), "weight")


def center_of_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """:func:`center` of all pairs of members, without making them: ``pairs`` (id1, id2, weight below 1) of representatives, ``members`` (id, rep).

    Copies come first, at weight 1, and have one mean: the first two meet, the second becomes the centre, and takes all others. From then on
    an edge to the class does something only if it is the centre's.
    """
    places = _placed(members)
    ends = places.where("place = least(n - 1, 1)")
    star = places.where("place <> 1 and n > 1").join(ends.select("rep", F.col("id").alias("end")), "rep").select(F.least("id", "end").alias("id1"), F.greatest("id", "end").alias("id2"), F.lit(1.0).alias("weight"))
    both = pairs.select(F.col("id1").alias("rep"), F.col("id2").alias("other"), "weight").unionByName(pairs.select(F.col("id2").alias("rep"), F.col("id1").alias("other"), "weight"))
    sizes = ends.select("rep", "n")
    sums = both.join(sizes.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum(F.col("weight") * F.col("n")).alias("s"), F.sum("n").alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    mean = F.try_divide(F.col("n") - 1 + zero("s"), F.col("n") - 1 + zero("c"))
    means = places.join(sums, "rep", "left").select(F.col("id").alias("x"), mean.alias("mean"))
    return center(cut(star.unionByName(_between(pairs, ends)), "links"), cut(means, "means"))


def unique_mapping_of_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """:func:`unique_mapping` of all pairs of members, without making them: ``pairs`` (id1, id2, weight below 1) of representatives, ``members`` (id, rep).

    Copies come first, at weight 1: the first with the second, the third with the fourth. Only the last of an odd number is left for other classes.
    """
    twos = _placed(members).groupBy("rep", F.floor(F.col("place") / 2).alias("k")).agg(F.min("id").alias("id1"), F.max("id").alias("id2"), F.count("*").alias("c"))
    twos = cut(twos, "twos")
    copies = twos.where("c = 2").select("id1", "id2", F.lit(1.0).alias("weight"))
    return unique_mapping(cut(copies.unionByName(_between(pairs, twos.where("c = 1").select("rep", F.col("id1").alias("id")))), "links"))


def merge_center(edges: DataFrame) -> DataFrame:
    """As :func:`center` with the first node as the centre; a centre that meets a member of another cluster merges both.

    Merging changes no node's state, so it comes after: an edge joins its ends' clusters if, when its turn comes, one is a centre and the other isn't free.
    """
    taken = _decide(edges.withColumn("c", F.col("id1")))
    rows = edges.select("id1", "id2", F.struct((-F.col("weight")).alias("w"), "id1", "id2").alias("k"))
    for i in (1, 2):
        rows = rows.join(taken.select(F.col("x").alias(f"id{i}"), F.col("state").alias(f"s{i}"), F.col("at").alias(f"a{i}")), f"id{i}")
    # by the time of the edge both are taken, this edge's own doing included
    merged = rows.where((F.col("a1") <= F.col("k")) & (F.col("a2") <= F.col("k")) & (F.col("s1") + F.col("s2") == CENTRE + MEMBER)).select("id1", "id2")
    found = connected_components(merged)
    return found.select(F.col("component").alias("cluster_id"), F.col("node").alias("profile_id"))


def merge_center_of_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """:func:`merge_center` of all pairs of members, without making them: ``pairs`` (id1, id2, weight below 1) of representatives, ``members`` (id, rep).

    Copies come first, at weight 1: the first becomes the centre and takes all others. From then on all others are members of one cluster, so
    an edge of any of them does what the second's does, and two of them do nothing: a pair of classes has three edges at most.
    """
    places = _placed(members)
    firsts, seconds = places.where("place = 0").select("rep", "id"), places.where("place = 1").select("rep", "id")
    star = places.where("place > 0").join(firsts.select("rep", F.col("id").alias("end")), "rep").select(F.col("end").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("weight"))
    edges = star
    for x, y in ((firsts, firsts), (firsts, seconds), (seconds, firsts)):
        edges = edges.unionByName(_between(pairs, x, y))
    return merge_center(cut(edges, "links"))


def unique_mapping(edges: DataFrame) -> DataFrame:
    """Heaviest edges first, each node in one pair at most."""
    return _named(_decide(edges.withColumn("c", F.col("id1")), pairs_only=True).select("x", F.col("of").alias("c")))


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {"center": center, "merge_center": merge_center, "unique_mapping": unique_mapping}
