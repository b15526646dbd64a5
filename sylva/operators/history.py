"""Revisions and their predecessors, a graph for each tree (``tree``, ``time_id``, ``previous`` array)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.operators.ordering import positions
from sylva.operators.reach import reach


def edges(history: DataFrame) -> DataFrame:
    """``tree``, ``time_id``, ``parent``, ``place`` of the parent among its revision's predecessors."""
    return history.select("tree", "time_id", F.posexplode("previous").alias("place", "parent"))


def tips(history: DataFrame) -> DataFrame:
    """Revisions that no other one of their tree has as a predecessor."""
    return history.join(edges(history).select("tree", F.col("parent").alias("time_id")), ["tree", "time_id"], "left_anti")


def forks(history: DataFrame) -> DataFrame:
    """``tree``, ``n_tips`` of trees with two tips or more."""
    return tips(history).groupBy("tree").agg(F.count("*").alias("n_tips")).where(F.col("n_tips") >= 2)


def lowest_tips(history: DataFrame, order: list[str]) -> DataFrame:
    """``tree``, ``loser``, ``winner``: the two lowest tips of each fork, the second of which wins.

    Two minima, each added up before the shuffle, rather than a sort of all tips.
    """
    found = tips(history)
    key = F.struct(*order, "time_id")
    first = found.groupBy("tree").agg(F.min(key).alias("first_"))
    later = found.join(first, "tree").where(key > F.col("first_"))
    second = later.groupBy("tree").agg(F.min(key).alias("second_"))
    return first.join(second, "tree").select("tree", F.col("first_.time_id").alias("loser"), F.col("second_.time_id").alias("winner"))


def winner_of(tips_: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest (``winner``) and smallest (``loser``) tip of each key."""
    place = F.struct(*order)
    return tips_.groupBy(*keys).agg(F.max(place).alias("winner"), F.min(place).alias("loser"))


def common_ancestor(history: DataFrame, pairs: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """``tree``, ``a``, ``b``, ``ancestor``: the revision in the history of both with the fewest hops from ``b``.

    Ties go to the first way by the places of predecessors, which is sought only where there are any; null if there
    is none.  ``pairs`` has ``tree``, ``a``, ``b``.
    """
    above = reach(history, pairs.select("tree", F.col("a").alias("start")).unionByName(pairs.select("tree", F.col("b").alias("start"))), order=order).checkpoint()
    rows = history.select("tree", "time_id").distinct()
    of_a = pairs.join(above.select("tree", F.col("start").alias("a"), "time_id"), ["tree", "a"])
    of_b = above.select("tree", F.col("start").alias("b"), "time_id", "hops")
    shared = of_a.join(of_b, ["tree", "b", "time_id"]).join(rows, ["tree", "time_id"], "left_semi")
    least = shared.groupBy("tree", "a", "b").agg(F.min("hops").alias("hops"))
    nearest = shared.join(least, ["tree", "a", "b", "hops"]).checkpoint()
    tied = nearest.groupBy("tree", "a", "b").agg(F.count("*").alias("n")).where("n > 1").select("tree", "a", "b").checkpoint()
    if tied.isEmpty():
        chosen = nearest.select("tree", "a", "b", F.col("time_id").alias("ancestor"))
    else:
        among = nearest.join(tied, ["tree", "a", "b"]).select("tree", F.col("b").alias("start"), "time_id").distinct()
        ways = reach(history, among.select("tree", "start").distinct(), order=order, routes_to=among).join(among, ["tree", "start", "time_id"], "left_semi")
        routed = nearest.join(ways.select("tree", F.col("start").alias("b"), "time_id", "route"), ["tree", "b", "time_id"], "left")
        chosen = routed.groupBy("tree", "a", "b").agg(F.min_by("time_id", F.struct("route")).alias("ancestor"))
    return pairs.select("tree", "a", "b").join(chosen, ["tree", "a", "b"], "left")


def relation(history: DataFrame, heads: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """``tree``, ``head``, ``time_id``, ``relation`` of every revision to its tree's head (``tree``, ``head``).

    ``behind``: the head is among the revision's predecessors or their ancestors, so following it is safe; ``ahead``:
    the revision is in the head's own history; else ``diverged``.
    """
    starts = heads.select("tree", F.col("head").alias("start"))
    above = reach(history, starts, order=order).select("tree", "time_id").withColumn("above", F.lit(True))
    below = reach(history, starts, up=False, order=order).where(F.col("hops") > 0).select("tree", "time_id").withColumn("below", F.lit(True))
    every = history.select("tree", "time_id").join(heads, "tree").join(above, ["tree", "time_id"], "left").join(below, ["tree", "time_id"], "left")
    kind = F.when(F.col("below"), "behind").when(F.col("above"), "ahead").otherwise("diverged")
    return every.select("tree", "head", "time_id", kind.alias("relation"))


def resolved_predecessors(history: DataFrame) -> DataFrame:
    """``tree``, ``time_id``, ``previous``: predecessors given as refs (``parent_refs``) as the ids of all other revisions with that ref.

    A revision whose parents are all unknown has none and becomes a root (null).
    """
    asked = history.select("tree", "time_id", F.explode("parent_refs").alias("ref"))
    ids = asked.join(history.select("tree", "ref", F.col("time_id").alias("parent")), ["tree", "ref"]).where(F.col("parent") != F.col("time_id"))
    found = ids.groupBy("tree", "time_id").agg(F.sort_array(F.collect_set("parent")).alias("previous"))
    return history.select("tree", "time_id").join(found, ["tree", "time_id"], "left")


def latest_predecessors(history: DataFrame) -> DataFrame:
    """Of several revisions of one ref the last one's predecessors count: ``tree``, ``ref``, ``time_id``, ``previous``."""
    last = history.groupBy("tree", "ref").agg(F.max(F.struct("time_id", "previous")).alias("last_"))
    return last.select("tree", "ref", "last_.time_id", "last_.previous")


def versions(history: DataFrame) -> DataFrame:
    """Every revision with its ``version`` number within its tree, from 1."""
    return positions(history, ["tree"], ["time_id"], "version")


#: Columns of a stored history, besides which tables may have more.
SCHEMA = T.StructType([T.StructField("tree", T.StringType()), T.StructField("time_id", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("previous", T.ArrayType(T.StringType()))])
