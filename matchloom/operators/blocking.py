"""Block building. A block collection is ``assignments``: (key, profile_id, source_id), one row a member.

Dirty collections (``clean=False``) compare all members of a block; clean ones only members of different sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..storage import cut
from .ranking import neighbours


def keyed(profiles: DataFrame, make_keys: Callable[[Column], Column] = K.tokens, remove_stop_words: bool = False) -> DataFrame:
    """(key, profile_id, source_id), each key of a profile once; keys are made distinct within the row, so nothing is shuffled."""
    rows = profiles.select(F.explode(F.array_distinct(make_keys(F.col("attributes")))).alias("key"), F.col("id").alias("profile_id"), "source_id").where(F.trim("key") != "")
    return rows.where(K.is_good_word(F.col("key"))) if remove_stop_words else rows


def sizes(assignments: DataFrame, clean: bool = False, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """(key, size, comparisons) of each block: n(n-1) for a dirty one, pairs of different sources for a clean one."""
    if not clean:
        return assignments.groupBy(*by).agg(F.count("*").alias("size")).withColumn("comparisons", F.col("size") * (F.col("size") - 1))
    each = assignments.groupBy(*by, "source_id").agg(F.count("*").alias("n"))
    both = each.groupBy(*by).agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return both.select(*by, "size", F.expr("(size * size - squares) div 2").alias("comparisons"))


def keep_comparable(assignments: DataFrame, clean: bool = False, by: tuple[str, ...] = ("key",), blocks: DataFrame | None = None) -> DataFrame:
    """Members of blocks that compare anything. The assignments are read twice unless ``blocks`` has their sizes: give a written table."""
    blocks = sizes(assignments, clean, by) if blocks is None else blocks
    return assignments.join(blocks.where("comparisons > 0").select(*by), list(by), "left_semi")


def token_blocking(profiles: DataFrame, clean: bool = False, make_keys: Callable[[Column], Column] = K.tokens, remove_stop_words: bool = False) -> DataFrame:
    """Profiles are cut into keys once; the keys are written down, since their sizes and their members are both read."""
    return keep_comparable(cut(keyed(profiles, make_keys, remove_stop_words), "keyed"), clean)


def schema_aware_blocking(profiles: DataFrame, clusters: DataFrame, clean: bool = True, drop_default: bool = False) -> DataFrame:
    """Token blocking within clusters of attributes.

    ``clusters`` is (cluster_id, source_id, attribute, entropy); attributes that it doesn't name fall into the
    cluster with the highest id. Keys are ``token_cluster``; rows carry cluster_id, entropy and the attributes.
    """
    default = clusters.agg(F.max("cluster_id").alias("default_id"), F.max_by("entropy", "cluster_id").alias("default_entropy"))
    named = clusters.where("attribute is not null").groupBy("source_id", "attribute").agg(F.collect_list(F.struct("cluster_id", "entropy")).alias("in"))
    of = named.agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("source_id").cast("long").alias("s"), F.col("attribute").alias("a")), F.col("in")))).alias("of"))  # an entry an attribute
    rows = profiles.select(F.col("id").alias("profile_id"), "source_id", K.usable(F.col("attributes")).alias("own")).join(F.broadcast(of.join(F.broadcast(default))))  # one row

    def placed(a: Column) -> Column:
        found = F.element_at("of", F.struct(F.col("source_id").cast("long").alias("s"), a["key"].alias("a")))
        default = F.struct(F.col("default_id").alias("cluster_id"), F.col("default_entropy").alias("entropy"))
        ids = lambda c: F.struct(F.coalesce(c["cluster_id"], "default_id").alias("cluster_id"), F.coalesce(c["entropy"], "default_entropy").alias("entropy"), a["key"].alias("attribute"), a["value"].alias("value"))
        return F.transform(F.coalesce(found, F.array(default)), ids)

    def beside(all_: Column) -> Column:
        """Each with whether others of the profile are in its cluster: only then can a key come twice."""
        return F.transform(all_, lambda p: F.struct(p.alias("p"), (F.size(F.filter(all_, lambda q: q["cluster_id"].eqNullSafe(p["cluster_id"]))) > 1).alias("many")))

    rows = rows.select("profile_id", "source_id", "default_id", F.explode(K.let(F.flatten(F.transform("own", placed)), beside)).alias("x"))
    rows = rows.select("profile_id", "source_id", "default_id", "x.many", "x.p")
    if drop_default:
        rows = rows.where("p.cluster_id <> default_id")
    rows = rows.select("profile_id", "source_id", "many", "p.cluster_id", "p.entropy", "p.attribute", F.explode(F.array_distinct(K.text_tokens(F.col("p.value")))).alias("token"))
    rows = cut(rows.withColumn("key", F.concat_ws("_", "token", F.col("cluster_id").cast("string"))).drop("token"), "parts")
    several = rows.where("many").groupBy("key", "profile_id", "source_id").agg(F.first("cluster_id").alias("cluster_id"), F.first("entropy").alias("entropy"), F.array_sort(F.collect_set("attribute")).alias("attributes"))
    alone = rows.where("not many").select("key", "profile_id", "source_id", "cluster_id", "entropy", F.array("attribute").alias("attributes"))
    return keep_comparable(alone.unionByName(cut(several, "several")), clean)


def neighbour_windows(profiles: DataFrame, window: int, make_keys: Callable[[Column], Column] = K.tokens, remove_stop_words: bool = False) -> DataFrame:
    """(key, members, ids): windows of ``window`` consecutive (key, profile) rows over the whole order, keyed by their first position; each profile once."""
    if window < 1:
        raise ValueError("a window has one row or more")
    near = neighbours(keyed(profiles, make_keys, remove_stop_words), ["key", "profile_id"], ["profile_id", "source_id"], window)
    # all windows are full but those of the last positions; of fewer rows than a window has, the first one stands
    whole = near.where(F.col(f"profile_id_{window - 1}").isNotNull() | (F.col("position") == 0))
    places = range(window)
    ids = F.array_distinct(F.array_compact(F.array(*[f"profile_id_{k}" for k in places])))
    each = [F.when(F.col(f"profile_id_{k}").isNotNull(), F.struct(F.col(f"profile_id_{k}").alias("profile_id"), F.col(f"source_id_{k}").alias("source_id"))) for k in places]
    return whole.select(F.col("position").alias("key"), F.array_distinct(F.array_compact(F.array(*each))).alias("members"), ids.alias("ids"))


def window_sizes(windows: DataFrame, clean: bool = False) -> DataFrame:
    """(key, size, comparisons) of the windows that compare anything, from their own rows."""
    size = F.size("ids").cast("long")
    of = lambda s: F.size(F.filter("members", lambda m: m["source_id"] == s)).cast("long")
    squares = F.aggregate(F.array_distinct("members.source_id"), F.lit(0).cast("long"), lambda a, s: a + of(s) * of(s))
    rows = windows.select("key", size.alias("size"), (squares if clean else F.lit(0)).alias("q"))
    return rows.select("key", "size", F.expr("(size * size - q) div 2" if clean else "size * (size - 1)").alias("comparisons")).where("comparisons > 0")


def sorted_neighbourhood(profiles: DataFrame, window: int, clean: bool = False, make_keys: Callable[[Column], Column] = K.tokens, remove_stop_words: bool = False) -> DataFrame:
    """The members of the windows that compare anything; a window knows that by itself, so nothing is shuffled for it."""
    windows = neighbour_windows(profiles, window, make_keys, remove_stop_words)
    apart = (F.size(F.array_distinct("members.source_id")) if clean else F.size("members")) > 1
    return windows.where(apart).select("key", F.explode("members").alias("m")).select("key", "m.profile_id", "m.source_id")
