"""Merkle trees of directories that are kept up to date without being rebuilt.

A directory's hash covers its name, path, number of children and the sum, lane by lane, of its children's hashes.  Sums can be
taken apart again: when a child changes, its old hash is subtracted and its new one added, so an update needs the changed
files and the directories above them, whatever else the tree holds.  ``lane0`` to ``lane3`` are stored with each directory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions import hashing, paths
from sylva.operators import nodes
from sylva.operators.ordering import checkpoint_dir

NODE = ("path", "name", "type", "is_parent", "n_children", "size", "blob_id", "mtime", "hash")
LANES = tuple(f"lane{k}" for k in range(4))
#: Columns of a state: nodes, the sums of directories, and whether a directory stays without children.
STATE = (*NODE, *LANES, "explicit")


def _sums(children: DataFrame) -> DataFrame:
    """``path`` of each parent, ``n_children`` and lanes; added up before the shuffle, so a directory costs a row for each task."""
    return children.groupBy(paths.parent(F.col("path")).alias("path")).agg(F.count("*").alias("n_children"), *hashing.set_lanes(F.col("hash")))


def _directories(rows: DataFrame) -> DataFrame:
    """Directory nodes of ``path``, ``n_children``, lanes and ``explicit``."""
    name = F.when(F.col("path") == paths.ROOT, F.lit(paths.ROOT)).otherwise(paths.basename(F.col("path")))
    digest = hashing.set_hash(F.lit("directory"), name, F.col("path"), F.col("n_children"))
    none = {"size": "long", "blob_id": "string", "mtime": "long"}
    made = rows.withColumns({"name": name, "type": F.lit("directory"), "is_parent": F.col("n_children") > 0, "hash": digest} | {n: F.lit(None).cast(t) for n, t in none.items()})
    return made.select(*STATE)


def _files(files: DataFrame) -> DataFrame:
    """File nodes with the columns of a state."""
    return nodes.file_nodes(files).withColumns({x: F.lit(None).cast("decimal(38,0)") for x in LANES} | {"explicit": F.lit(False)}).select(*STATE)


def _long_sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("decimal(38,0)").alias(name)


def roll_up(files: DataFrame, explicit_dirs: DataFrame | None = None) -> DataFrame:
    """The state of the tree over ``files`` (``path``, ``blob_id``, ``size``, ``mtime``), hashed level by level up to the root.

    ``explicit_dirs`` (``path``) may be empty directories.
    """
    checkpoint_dir(files.sparkSession)
    leaves = _files(files)
    found = nodes.directories(files, explicit_dirs)
    own = None if explicit_dirs is None else explicit_dirs.select("path").distinct().withColumn("explicit", F.lit(True))
    told = found.withColumn("explicit", F.lit(False)) if own is None else found.join(own, "path", "left").withColumn("explicit", F.coalesce("explicit", F.lit(False)))
    dirs = told.withColumn("depth", paths.depth(F.col("path"))).checkpoint()
    deepest = dirs.agg(F.max("depth").alias("d")).first()["d"]
    # all files are summed up in one pass, to a row for each directory
    of_files = _sums(leaves).checkpoint()
    below, done = leaves.limit(0), [leaves]
    for level in range(deepest, -1, -1):
        here = dirs.where(F.col("depth") == level).select("path", "explicit")
        parts = of_files.join(here, "path", "left_semi").unionByName(_sums(below))
        sums = parts.groupBy("path").agg(F.sum("n_children").alias("n_children"), *(_long_sum(x) for x in LANES))
        filled = here.join(sums, "path", "left").select("path", "explicit", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), *(F.coalesce(x, F.lit(0)).cast("decimal(38,0)").alias(x) for x in LANES))
        below = _directories(filled).checkpoint()
        done.append(below)
    return reduce(DataFrame.unionByName, done)


def _differences(rows: DataFrame) -> DataFrame:
    """``path`` of each parent and what its sums change by, of ``path``, ``before`` and ``after`` (hashes, null if there is none)."""
    rows = rows.where(~F.col("before").eqNullSafe(F.col("after")) & (F.col("path") != paths.ROOT))
    sign = [rows.where(f"{c} is not null").select("path", F.col(c).alias("hash"), F.lit(k).alias("sign")) for c, k in (("before", -1), ("after", 1))]
    both = sign[0].unionByName(sign[1])
    sums = both.groupBy(paths.parent(F.col("path")).alias("path"), "sign").agg(F.count("*").alias("n_children"), *hashing.set_lanes(F.col("hash")))
    return sums.groupBy("path").agg(F.sum(F.col("sign") * F.col("n_children")).alias("d_children"), *(F.sum(F.col("sign").cast("decimal(1,0)") * F.col(x)).cast("decimal(38,0)").alias(f"d_{x}") for x in LANES))


def update(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of a state that ``changed`` entries alter: ``gone`` and the columns of a state.

    ``changed`` has ``path``, ``type``, ``blob_id``, ``size``, ``mtime`` and ``gone``, one row for each path: a file or an explicit
    directory that is new, different or no longer there.  A directory stays as long as it is explicit or has a child, and
    is made with its first one; what lies below a directory that goes must be among the changes too.

    Only changed paths and directories above them are read and written; a level goes on only with what it altered.
    """
    checkpoint_dir(state.sparkSession)
    is_file = F.col("type") == "file"
    changed = changed.select("path", "type", "blob_id", "size", "mtime", "gone").checkpoint()
    dirs = changed.where(~is_file).select("path", (~F.col("gone")).alias("told"))
    touched = changed.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).unionByName(dirs.select("path")).distinct()
    root = changed.limit(1).select(F.lit(paths.ROOT).alias("path"))
    wanted = changed.select("path").unionByName(touched).unionByName(root).distinct()
    old = state.select(*STATE).join(wanted, "path", "left_semi").checkpoint()
    # a path that was a file and is a directory now has a row of either kind
    fresh = _files(changed.where(is_file & ~F.col("gone")))
    were = old.where(is_file).join(changed.select("path"), "path", "left_semi")
    files = were.select("path", F.col("hash").alias("before")).join(fresh.select("path", F.col("hash").alias("after")), "path", "full_outer").checkpoint()
    # a file in the place of a directory ends it
    ended = old.where(~is_file).join(fresh.select("path"), "path", "left_semi").select("path", F.lit(False).alias("told"))
    dirs = dirs.unionByName(ended)
    # without changes there is nothing to be done, not even at the root
    depths = touched.unionByName(ended.select("path")).unionByName(root).distinct().withColumn("depth", paths.depth(F.col("path"))).join(dirs, "path", "left").checkpoint()
    deepest = depths.agg(F.max("depth").alias("d")).first()["d"]
    of_files = _differences(files).checkpoint()
    done, below = [fresh.withColumn("gone", F.lit(False))], files.limit(0)
    lost = files.where("after is null").select("path")
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = depths.where(F.col("depth") == level).select("path", "told")
        parts = of_files.join(here, "path", "left_semi").unionByName(_differences(below))
        sums = parts.groupBy("path").agg(F.sum("d_children").alias("d_children"), *(F.sum(f"d_{x}").cast("decimal(38,0)").alias(f"d_{x}") for x in LANES))
        before = old.where("type = 'directory'").select("path", "n_children", *LANES, F.col("explicit").alias("was"), F.col("hash").alias("before"))
        joined = here.join(sums, "path", "left").join(before, "path", "left")
        total = lambda c, kind: (F.coalesce(F.col(c), F.lit(0).cast(kind)) + F.coalesce(F.col("d_children" if c == "n_children" else f"d_{c}"), F.lit(0).cast(kind))).cast(kind).alias(c)
        filled = joined.select("path", "before", total("n_children", "long"), *(total(x, "decimal(38,0)") for x in LANES), F.coalesce("told", "was", F.lit(False)).alias("explicit"))
        made = _directories(filled).join(filled.select("path", "before"), "path")
        stays = (F.col("path") == paths.ROOT) | (F.col("n_children") > 0) | F.col("explicit")
        made = made.withColumn("gone", ~stays).withColumn("after", F.when(stays, F.col("hash"))).where("before is not null or after is not null").checkpoint()
        done.append(made.select("gone", *STATE))
        below = made.select("path", "before", "after")
    result = reduce(DataFrame.unionByName, [d.select("gone", *STATE) for d in done])
    # files that go, unless a directory has taken their path
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema if f.name not in ("gone", "path", "type")]
    taken = result.where("not gone").select("path")
    return result.unionByName(lost.join(taken, "path", "left_anti").select(F.lit(True).alias("gone"), "path", F.lit("file").alias("type"), *none))


def applied(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A state with the rows of :func:`update` in the places of those of their paths."""
    kept = state.select(*STATE).join(changes.select("path").distinct(), "path", "left_anti")
    return kept.unionByName(changes.where(~F.col("gone")).select(*STATE))
