"""Tree nodes: files and directories with hashes that go up to the root, and lookups among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import hashing, paths
from sylva.operators.ordering import checkpoint_dir, positions


def file_nodes(files: DataFrame) -> DataFrame:
    """Files (``path``, ``blob_id``, ``size``, ``mtime`` in ms) as nodes; the time of change is part of the hash."""
    name = paths.basename(F.col("path"))
    digest = hashing.fields_hash(F.lit("file"), name, F.col("path"), F.col("size"), F.col("blob_id"), F.col("mtime"))
    return files.select("path", name.alias("name"), F.lit("file").alias("type"), F.lit(False).alias("is_parent"), F.lit(0).cast("long").alias("n_children"), "size", "blob_id", "mtime", digest.alias("hash"))


def directories(files: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """``path`` of the root and all directories above a file, with the ``explicit`` ones, which may be empty."""
    above = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))
    if explicit is not None:
        above = above.unionByName(explicit.select(F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")))
    root = files.sparkSession.range(1).select(F.lit(paths.ROOT).alias("path"))
    return above.unionByName(root).distinct()


def merkle_nodes(files: DataFrame, explicit_dirs: DataFrame | None = None) -> DataFrame:
    """All nodes of the tree over ``files``, hashed level by level from the leaves to the root (see :mod:`.merkle`)."""
    from sylva.operators import merkle

    return merkle.roll_up(files, explicit_dirs).select(*merkle.NODE)


def children(nodes: DataFrame) -> DataFrame:
    """``parent_path``, ``pos`` from 1 in byte order of the names, ``path``, ``hash``: the edges of the tree."""
    edges = nodes.where(F.col("path") != paths.ROOT).select(paths.parent(F.col("path")).alias("parent_path"), "name", "path", "hash")
    return positions(edges, ["parent_path"], ["name"]).select("parent_path", "pos", "path", "hash")


def fetch_tree(nodes: DataFrame, edges: DataFrame, root_hash: str) -> DataFrame:
    """All nodes under ``root_hash`` with their ``level``, following ``edges`` (``parent_hash``, ``hash``) breadth first.

    A child without a node is left out, a node reached twice is given once, at its first level.
    """
    if not (root_hash or "").strip():
        raise ValueError("the root hash must not be blank")
    checkpoint_dir(nodes.sparkSession)
    frontier = nodes.where(F.col("hash") == root_hash).select("hash", F.lit(0).alias("level")).distinct().checkpoint()
    if frontier.isEmpty():
        raise LookupError(f"there is no node {root_hash}")
    seen, level = frontier, 0
    while True:
        level += 1
        step = frontier.select(F.col("hash").alias("parent_hash")).join(edges, "parent_hash").select("hash").distinct()
        frontier = step.join(seen.select("hash"), "hash", "left_anti").join(nodes.select("hash").distinct(), "hash", "left_semi").select("hash", F.lit(level).alias("level")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier).checkpoint()
    return nodes.join(seen, "hash")


def blob_table(files: DataFrame) -> DataFrame:
    """Blobs stored once: ``blob_id``, ``size``, ``n_files``, ``first_path``, ``bytes_saved``."""
    grouped = files.groupBy("blob_id").agg(F.max("size").alias("size"), F.count("*").alias("n_files"), F.min("path").alias("first_path"))
    return grouped.withColumn("bytes_saved", F.col("size") * (F.col("n_files") - 1))


def within_depth(nodes: DataFrame, most: int | None) -> DataFrame:
    """Nodes of at most ``most`` levels below the root; all if it is None."""
    return nodes if most is None else nodes.where(paths.depth(F.col("path")) <= most)


def new_nodes(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes whose hash isn't stored yet, each hash once."""
    return nodes.join(stored.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def layered(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local rows, and remote ones whose key isn't there, with their ``layer``."""
    rest = remote.join(local.select(key), key, "left_anti")
    return local.withColumn("layer", F.lit("local")).unionByName(rest.withColumn("layer", F.lit("remote")))
