"""Three-way merging of content maps with copies of what the losing side had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators.ordering import checkpoint_dir


def merge_plan(ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, winner: str = "theirs") -> DataFrame:
    """Every path with the three sides' values, ``merged`` (null: gone), ``conflict`` and ``lost``, the losing value.

    Sides that agree decide; else the side that changed; a path that both changed differently is a conflict, which the
    winner decides.  Absence is null and is a change like any other.
    """
    if winner not in ("ours", "theirs"):
        raise ValueError(f"no such side: {winner}")
    sides = [x.select("path", F.col("blob_id").alias(n)) for x, n in ((ancestor, "a"), (ours, "b"), (theirs, "c"))]
    joined = sides[0].join(sides[1], "path", "full_outer").join(sides[2], "path", "full_outer")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    won, lost = (b, c) if winner == "ours" else (c, b)
    clear = F.when(b.eqNullSafe(c), b).when(b.eqNullSafe(a), c).when(c.eqNullSafe(a), b)
    conflict = ~b.eqNullSafe(c) & ~b.eqNullSafe(a) & ~c.eqNullSafe(a)
    return joined.select("path", "a", "b", "c", F.when(conflict, won).otherwise(clear).alias("merged"), conflict.alias("conflict"), F.when(conflict, lost).alias("lost"))


def merged_map(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("merged").isNotNull()).select("path", F.col("merged").alias("blob_id"))


def conflict_paths(plan: DataFrame) -> DataFrame:
    return plan.where("conflict").select("path")


def conflict_copies(plan: DataFrame, client: Column, ms: Column) -> DataFrame:
    """``path``, ``copy_path``, ``blob_id``: what the losing side had in a conflict, under a free name.

    Names that are taken, by a path of any side or by another copy, get the smallest free number.  Different
    paths can only wish for one name if they differ in nothing that the name keeps, so numbers are tried in rounds of an
    anti join, each of which settles all copies but those whose name was taken.
    """
    checkpoint_dir(plan.sparkSession)
    taken = plan.select(F.col("path").alias("copy_path"))
    open_ = plan.where(F.col("conflict") & F.col("lost").isNotNull() & (F.col("lost") != paths.DIR_MARKER)).select("path", F.col("lost").alias("blob_id"), client.alias("client"), ms.alias("ms"))
    settled: list[DataFrame] = []
    number = 0
    while True:
        wish = open_.withColumn("copy_path", paths.conflict_name(F.col("path"), F.col("client"), F.col("ms"), F.lit(number)))
        # of several copies that wish for one name the smallest path gets it
        first = wish.groupBy("copy_path").agg(F.min("path").alias("path"))
        got = wish.join(first.join(taken, "copy_path", "left_anti"), ["copy_path", "path"], "left_semi").checkpoint()
        settled.append(got.select("path", "copy_path", "blob_id"))
        open_ = open_.join(got.select("path"), "path", "left_anti").checkpoint()
        if open_.isEmpty():
            break
        taken = taken.unionByName(got.select("copy_path"))
        number += 1
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def materialised(plan: DataFrame, copies: DataFrame, winner: str = "theirs") -> DataFrame:
    """The tree that resolving leaves behind: ``path``, ``blob_id``, ``origin`` (merged, copy, directory).

    Files are the merged ones and the copies.  Directory markers are neither written nor removed: directories are
    the winner's and those above a file.
    """
    files = merged_map(plan).where(F.col("blob_id") != paths.DIR_MARKER).withColumn("origin", F.lit("merged"))
    files = files.unionByName(copies.select(F.col("copy_path").alias("path"), "blob_id", F.lit("copy").alias("origin")))
    implied = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))
    own = plan.where(F.col("b" if winner == "ours" else "c") == paths.DIR_MARKER).select("path")
    dirs = implied.unionByName(own).where(F.col("path") != paths.ROOT).distinct()
    return files.unionByName(dirs.select("path", F.lit(paths.DIR_MARKER).alias("blob_id"), F.lit("directory").alias("origin")))
