"""Resolving a fork: the two lowest tips, or all of them, are merged and the result becomes a revision of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators import compare, history, merge


@dataclass
class Resolution:
    """The losing and the winning revision, the plan of their merge, and the tree it leaves (``path``, ``blob_id``, ``origin``, ``mtime``)."""

    loser: str
    winner: str
    plan: DataFrame
    result: DataFrame
    #: All revisions that were merged, the two by default.
    tips: tuple[str, ...] = ()


def resolve(store, tree: str) -> Resolution | None:
    """Merges the two lowest tips by (time, client, ref); None without a fork.

    The greater tip wins and is ``theirs``; without a common ancestor everything counts as added.
    """
    revisions = store.history(tree).withColumn("tip_client", F.coalesce("origin", F.lit(""))).withColumn("tip_ts", F.coalesce("client_ts", F.lit(0)))
    pair = history.lowest_tips(revisions, ["tip_ts", "tip_client", "ref"]).first()
    if pair is None:
        return None
    rows = {r["time_id"]: r for r in revisions.where(F.col("time_id").isin(pair["loser"], pair["winner"])).collect()}
    pairs = store.spark.createDataFrame([(tree, pair["loser"], pair["winner"])], "tree string, a string, b string")
    shared = history.common_ancestor(revisions, pairs).first()["ancestor"]
    loser, winner = rows[pair["loser"]], rows[pair["winner"]]
    trees = [store.get(r["ref"]) for r in (loser, winner)]
    maps = [compare.content_map(t) for t in trees]
    if shared is None:
        base = maps[0].limit(0)
    else:
        base = compare.content_map(store.get(revisions.where(F.col("time_id") == shared).first()["ref"]))
    plan = merge.merge_plan(base, maps[0], maps[1])
    copies = merge.conflict_copies(plan, F.lit(loser["tip_client"]), F.lit(loser["tip_ts"]))
    result = with_times(merge.materialised(plan, copies), copies, *trees)
    return Resolution(pair["loser"], pair["winner"], plan, result)


def with_times(result: DataFrame, copies: DataFrame, loser: DataFrame, winner: DataFrame) -> DataFrame:
    """``result`` with ``mtime``: that of the side whose content a file has, the winner's if both have it; a copy's is the loser's."""
    of_winner, of_loser = (t.where("type = 'file'").select(F.col("path").alias("from_"), "blob_id", F.col("mtime").alias(n)) for t, n in ((winner, "winner_"), (loser, "loser_")))
    named = copies.select(F.col("copy_path").alias("path"), F.col("path").alias("copied_"))
    rows = result.join(named, "path", "left").withColumn("from_", F.coalesce("copied_", "path"))
    rows = rows.join(of_winner, ["from_", "blob_id"], "left").join(of_loser, ["from_", "blob_id"], "left")
    mtime = F.when(F.col("origin") == "copy", F.col("loser_")).otherwise(F.coalesce("winner_", "loser_"))
    return rows.select("path", "blob_id", "origin", mtime.alias("mtime"))


def store_resolution(store, tree: str, found: Resolution) -> str:
    """Stores the merged tree with both tips as predecessors; the new revision's id."""
    files = found.result.where(F.col("blob_id") != paths.DIR_MARKER).join(store.blobs, "blob_id").select("path", F.lit("file").alias("type"), F.octet_length("content").cast("long").alias("size"), "mtime", "blob_id", "content")
    dirs = found.result.where(F.col("blob_id") == paths.DIR_MARKER).select("path", F.lit("directory").alias("type"), *(F.lit(None).cast(t).alias(n) for n, t in (("size", "long"), ("mtime", "long"), ("blob_id", "string"), ("content", "binary"))))
    return store.put(files.unionByName(dirs), tree, list(found.tips or (found.loser, found.winner)))[1]


#: Stands for what nearest ancestors don't agree on: no side's value equals it, so both count as changed.
SEVERAL = "<several>"


def nearest_ancestors(revisions: DataFrame, merged: DataFrame, tip: DataFrame) -> DataFrame:
    """``time_id`` of the common ancestors of ``tip`` and any of ``merged`` (``tree``, ``start``) that no other one descends from."""
    ids = revisions.select("tree", "time_id").distinct()
    above = [history.reach(revisions, starts).select("tree", "time_id").distinct() for starts in (merged, tip)]
    shared = above[0].join(above[1], ["tree", "time_id"]).join(ids, ["tree", "time_id"], "left_semi").checkpoint()
    # an ancestor of a shared one is shared too, so it is enough to leave out their parents
    parents = history.edges(revisions).join(shared, ["tree", "time_id"], "left_semi").select("tree", F.col("parent").alias("time_id"))
    return shared.join(parents, ["tree", "time_id"], "left_anti").select("time_id")


def virtual_base(bases: list[DataFrame], empty: DataFrame) -> DataFrame:
    """A content map of several: what all of them agree on, and :data:`SEVERAL` where they don't."""
    if len(bases) < 2:
        return bases[0] if bases else empty
    rows = reduce(DataFrame.unionByName, bases).groupBy("path").agg(F.count("*").alias("n"), F.min("blob_id").alias("least"), F.max("blob_id").alias("most"))
    return rows.select("path", F.when((F.col("n") == len(bases)) & (F.col("least") == F.col("most")), F.col("least")).otherwise(SEVERAL).alias("blob_id"))


def resolve_all(store, tree: str) -> Resolution | None:
    """Merges all tips, one after the other by (time, client, ref); None without a fork.

    The greater tip wins each conflict, and what was there before is kept as a copy under the name of the client it came
    from.  The base of a step is the nearest common ancestor of the tip and of all that is merged already; where there are
    several (revisions that merged each other crosswise) it is what they agree on.
    """
    revisions = store.history(tree).withColumn("tip_client", F.coalesce("origin", F.lit(""))).withColumn("tip_ts", F.coalesce("client_ts", F.lit(0))).checkpoint()
    tips = history.tips(revisions).orderBy("tip_ts", "tip_client", "ref", "time_id").collect()
    if len(tips) < 2:
        return None
    spark, plan = store.spark, None
    start = lambda *of: spark.createDataFrame([(tree, t["time_id"]) for t in of], "tree string, start string")

    def side(tip) -> DataFrame:
        nodes = store.get(tip["ref"])
        times = nodes.where("type = 'file'").select("path", "mtime")
        return compare.content_map(nodes).join(times, "path", "left").withColumns({"client": F.lit(tip["tip_client"]), "ms": F.lit(tip["tip_ts"])}).checkpoint()

    held = side(tips[0])
    for k, tip in enumerate(tips[1:], 1):
        found = nearest_ancestors(revisions, start(*tips[:k]), start(tip))
        refs = [r["ref"] for r in revisions.join(found, "time_id", "left_semi").select("ref").distinct().collect()]
        theirs = side(tip)
        base = virtual_base([compare.content_map(store.get(r)) for r in refs], theirs.select("path", "blob_id").limit(0))
        known = [x.select("path", *(F.col(c).alias(f"{n}_{c}") for c in ("mtime", "client", "ms"))) for n, x in (("b", held), ("c", theirs))]
        plan = merge.merge_plan(base, held, theirs).join(known[0], "path", "left").join(known[1], "path", "left").checkpoint()
        copies = merge.conflict_copies(plan, F.col("b_client"), F.col("b_ms")).checkpoint()
        result = merge.materialised(plan, copies)
        of = plan.select("path", *(F.when(F.col("merged").eqNullSafe(F.col("c")), F.col(f"c_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in ("mtime", "client", "ms")))
        of = of.unionByName(copies.join(known[0], "path").select(F.col("copy_path").alias("path"), F.col("b_mtime").alias("mtime"), F.col("b_client").alias("client"), F.col("b_ms").alias("ms")))
        held = result.join(of, "path", "left").checkpoint()
    return Resolution(tips[0]["time_id"], tips[-1]["time_id"], plan, held.select("path", "blob_id", "origin", "mtime"), tuple(t["time_id"] for t in tips))
