"""What restoring a tree writes and removes, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import paths


def expected_paths(entries: DataFrame) -> DataFrame:
    """``path``, ``kind`` of all files and directories that a content map implies, the root included."""
    files = entries.where(F.col("blob_id") != paths.DIR_MARKER).select("path", F.lit("file").alias("kind"))
    named = entries.where(F.col("blob_id") == paths.DIR_MARKER).select("path")
    above = entries.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))
    root = entries.sparkSession.range(1).select(F.lit(paths.ROOT).alias("path"))
    return files.unionByName(named.unionByName(above).unionByName(root).distinct().withColumn("kind", F.lit("directory")))


def prune_files(present: DataFrame, before: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (``path``) that are present, were there before the restore, and aren't expected."""
    keep = expected.where(F.col("kind") == "file").select("path")
    return present.select("path").join(before.select("path"), "path", "left_semi").join(keep, "path", "left_anti")


def prune_directories(present: DataFrame, pruned: DataFrame, expected: DataFrame) -> DataFrame:
    """Directories that aren't expected and hold no file that stays; ``depth`` to remove the deepest first."""
    stay = present.select("path").join(pruned.select("path"), "path", "left_anti")
    held = stay.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    there = present.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    keep = expected.where(F.col("kind") == "directory").select("path")
    return there.join(held, "path", "left_anti").join(keep, "path", "left_anti").select("path", paths.depth(F.col("path")).alias("depth"))


def last_by_name(blobs: DataFrame, name: str, order: str) -> DataFrame:
    """Blobs written flat by name: of several the last in ``order`` stays."""
    value = F.struct(*blobs.columns)
    return blobs.groupBy(name).agg(F.max_by(value, F.col(order)).alias("last_")).select("last_.*")
