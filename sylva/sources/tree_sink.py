"""A directory as a transactional sink of trees.

``tree.write.format("sylva_tree").option("path", target).mode(...).save()`` writes rows of ``path``, ``type``, ``mtime`` and
``content`` (files) below ``target``:

- ``overwrite``: the target holds just these rows afterwards.  Tasks write into a folder beside the target, which takes the
  target's place in the commit by two renames, whatever the size of either tree.
- ``append``: rows are added to what is there, and files of the same path replaced.  Tasks write temporaries into one folder
  within the target; the commit moves them into place by the lists that the tasks have left there, and a commit that
  breaks off is finished by :func:`recover` or the next write.

Nothing of a failed job is seen: a task that fails, or runs twice, leaves only temporaries of its own, which abort or the
next write removes.  Of several rows of one path, one is kept.  Times of change are set before files are moved.

The driver goes through the lists row by row and holds a bounded number of rows and directories, whatever a job writes.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sylva.operators.ordering import mounted
from sylva.sources.directory import RestoreError

SCHEMA = "path string, type string, mtime long, content binary"
STAGING, _DECIDED = ".sylva-tmp-job-", "decided"
#: Files that a commit moves at once, rows of the lists that it holds for each of these, and directories that it remembers.
MOVES, MOVE_ROWS, KNOWN = 32, 128, 65_536


@dataclass
class Written(WriterCommitMessage):
    """The list of what a task has written, a file in the staging folder; only its name goes to the driver."""

    manifest: str


def _checked(path: str) -> str:
    clean = os.path.normpath(path)
    if os.path.isabs(clean) or clean == ".." or clean.startswith("../"):
        raise RestoreError(f"{path} leaves the target")
    if any(part.startswith(STAGING) for part in clean.split("/")):
        raise RestoreError(f"{path} has the name of a staging folder")
    return clean


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.target, self.overwrite = os.path.abspath(mounted(options["path"])), overwrite
        # where what is written can be moved without being copied
        name = f"{os.path.basename(self.target)}." if overwrite else ""
        self.staging = os.path.join(os.path.dirname(self.target) if overwrite else self.target, f"{STAGING}{name}{uuid.uuid4().hex}")
        self.made_target = not overwrite and not os.path.isdir(self.target)
        # tasks make no folder but their own, so once this one is gone a task that still runs can't leave anything
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Every attempt of a task has a folder of its own, so the one that is committed is whole; one that fails removes it."""
        own = os.path.join(self.staging, f"task-{uuid.uuid4().hex}")
        os.mkdir(own)
        try:
            return self._write(iterator, own)
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise

    def _write(self, iterator: Iterator[Row], own: str) -> Written:
        manifest = f"{own}.json"
        with open(f"{manifest}.part", "w") as told:
            for k, row in enumerate(iterator):
                path = _checked(row["path"])
                if row["type"] == "directory":
                    told.write(json.dumps(["directory", path, None]) + "\n")
                elif row["type"] == "file":
                    temporary = os.path.join(own, str(k))
                    with open(temporary, "wb") as f:
                        f.write(bytes(row["content"] or b""))
                    if row["mtime"] is not None:
                        os.utime(temporary, ns=(row["mtime"] * 1_000_000,) * 2)
                    told.write(json.dumps(["file", path, os.path.relpath(temporary, self.staging)]) + "\n")
        os.replace(f"{manifest}.part", manifest)
        return Written(os.path.basename(manifest))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        manifests = [m.manifest for m in messages if m is not None]
        if self.overwrite:
            building, whole = os.path.join(self.staging, "building"), os.path.join(self.staging, "whole")
            os.makedirs(building)
            _verify(self.staging, manifests, building, building)
            _place(self.staging, manifests, building)
            os.rename(building, whole)
            if os.path.lexists(self.target):
                os.rename(self.target, os.path.join(self.staging, "old"))
            os.rename(whole, self.target)
        else:
            _verify(self.staging, manifests, self.target, os.path.join(self.staging, "skeleton"))
            # from here on the job counts as done, and what is left of it is only to be finished
            part = os.path.join(self.staging, f"{_DECIDED}.part")
            with open(part, "w") as f:
                json.dump(manifests, f)
            os.replace(part, os.path.join(self.staging, _DECIDED))
            _place(self.staging, manifests, self.target)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if not os.path.exists(os.path.join(self.staging, _DECIDED)):
            gone = f"{self.staging}.gone"
            os.rename(self.staging, gone)
            shutil.rmtree(gone, ignore_errors=True)
            if self.made_target and not os.listdir(self.target):
                os.rmdir(self.target)


def _entries(staging: str, manifests: list[str]) -> Iterator[tuple[str, str, str | None]]:
    for name in manifests:
        with open(os.path.join(staging, name)) as f:
            yield from map(json.loads, f)


def _above(kind: str, path: str) -> str:
    return path if kind == "directory" else os.path.dirname(path) or "."


def _verify(staging: str, manifests: list[str], target: str, skeleton: str) -> None:
    """Whether everything can be placed, before anything is; leaves the directories of all rows in ``skeleton``."""
    root, known = os.path.realpath(target), set()
    os.makedirs(skeleton, exist_ok=True)
    for kind, path, _ in _entries(staging, manifests):
        at = _above(kind, path)
        if at not in known:
            os.makedirs(os.path.join(skeleton, at), exist_ok=True)
        while at != "." and at not in known:
            full = os.path.join(target, at)
            if os.path.lexists(full):
                if not os.path.isdir(full):
                    raise RestoreError(f"a file stands at or above {path}")
                if not (os.path.realpath(full) + os.sep).startswith(root + os.sep):
                    raise RestoreError(f"{path} leaves the target")
            _remember(known, at)
            at = os.path.dirname(at) or "."
    for kind, path, _ in _entries(staging, manifests):
        if kind == "file" and any(os.path.isdir(os.path.join(top, path)) for top in {skeleton, target}):
            raise RestoreError(f"a directory stands at {path}")


def _remember(known: set[str], directory: str) -> None:
    if len(known) >= KNOWN:
        known.clear()
    known.add(directory)


def _place(staging: str, manifests: list[str], target: str) -> None:
    """Makes the directories and moves the files of all tasks; may be done again, since what has been moved is passed over."""
    made: set[str] = set()

    def move(files: list[tuple[str, str, str | None]]) -> None:
        for _, path, name in files:
            source = os.path.join(staging, name)
            if os.path.exists(source):
                os.replace(source, os.path.join(target, path))

    entries = _entries(staging, manifests)
    with ThreadPoolExecutor(MOVES) as pool:
        while held := list(islice(entries, MOVES * MOVE_ROWS)):
            for kind, path, _ in held:
                if (at := _above(kind, path)) not in made:
                    os.makedirs(os.path.join(target, at), exist_ok=True)
                    _remember(made, at)
            files = [e for e in held if e[0] == "file"]
            for _ in pool.map(move, (files[k::MOVES] for k in range(min(MOVES, len(files))))):
                pass


def recover(target: str) -> int:
    """Finishes commits into ``target`` that broke off and removes what other jobs have left; how many were finished.

    No job may be writing to it meanwhile.
    """
    target, done = os.path.abspath(mounted(target)), 0
    above, name = os.path.split(target)
    for found in sorted(os.listdir(above)) if os.path.isdir(above) else []:
        if found.startswith(f"{STAGING}{name}."):
            staging = os.path.join(above, found)
            for part in ("whole", "old"):
                if not os.path.lexists(target) and os.path.isdir(os.path.join(staging, part)):
                    os.rename(os.path.join(staging, part), target)
                    done += part == "whole"
            shutil.rmtree(staging, ignore_errors=True)
    for found in sorted(os.listdir(target)) if os.path.isdir(target) else []:
        if found.startswith(STAGING):
            staging = os.path.join(target, found)
            if os.path.exists(decided := os.path.join(staging, _DECIDED)):
                with open(decided) as f:
                    _place(staging, json.load(f), target)
                done += 1
            shutil.rmtree(staging, ignore_errors=True)
    return done


class TreeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sylva_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options, overwrite)


def write(tree: DataFrame, blobs: DataFrame, target: str, overwrite: bool = False) -> None:
    """Writes a tree (``path``, ``type``, ``blob_id``, ``mtime``) with the contents of ``blobs``, wholly or not at all.

    A file whose blob isn't stored is an error; files without a blob id and entries of other types are left out.
    """
    spark = tree.sparkSession
    spark.dataSource.register(TreeSink)
    dirs = tree.where("type = 'directory'").select("path", "type", F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("binary").alias("content"))
    held = tree.where("type = 'file' AND blob_id IS NOT NULL").select("path", "type", "mtime", "blob_id").join(blobs.select("blob_id", "content"), "blob_id", "left")
    lost = F.raise_error(F.concat(F.lit("no blob for "), "path")).cast("binary")
    files = held.select("path", "type", F.col("mtime").cast("long").alias("mtime"), F.coalesce("content", lost).alias("content"))
    rows = dirs.unionByName(files).where(F.col("path") != ".")
    rows.write.format("sylva_tree").option("path", target).mode("overwrite" if overwrite else "append").save()
