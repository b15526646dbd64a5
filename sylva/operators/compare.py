"""Content maps and their comparison.  A content map has ``path`` (unique) and ``blob_id``; directories have a marker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import hashing, paths


def content_map(nodes: DataFrame) -> DataFrame:
    """Files with their blob (empty if missing) and directories but the root; nodes of other types are left out."""
    kept = nodes.where((F.col("type") == "file") | ((F.col("type") == "directory") & (F.col("path") != paths.ROOT)))
    return kept.select("path", F.when(F.col("type") == "file", F.coalesce("blob_id", F.lit(""))).otherwise(paths.DIR_MARKER).alias("blob_id"))


def content_key(entries: DataFrame, *tree: str) -> DataFrame:
    """``tree`` columns, ``n_entries``, ``content_key``: equal for trees of equal paths and blobs, whatever their times."""
    member = hashing.fields_hash(F.col("path"), F.col("blob_id"))
    sums = entries.groupBy(*tree).agg(F.count("*").alias("n_entries"), *hashing.set_lanes(member))
    return sums.select(*tree, "n_entries", hashing.set_hash(F.col("n_entries")).alias("content_key"))


def content_equal(left: DataFrame, right: DataFrame, *tree: str) -> DataFrame:
    """``tree`` columns and ``equal`` for every tree of either side."""
    a, b = (content_key(x, *tree).select(*tree, F.col("content_key").alias(n)) for x, n in ((left, "key_a"), (right, "key_b")))
    return a.join(b, list(tree), "full_outer").select(*tree, F.col("key_a").eqNullSafe(F.col("key_b")).alias("equal"))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``change`` (added, modified, deleted), ``before``, ``after`` of the paths that differ."""
    a, b = before.select("path", F.col("blob_id").alias("before")), after.select("path", F.col("blob_id").alias("after"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "path", "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return both.select("path", change.alias("change"), "before", "after").where(F.col("change").isNotNull())
