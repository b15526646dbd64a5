"""Directories listed and read on the executors, and trees written back to one.

The directory must be mounted at the same place on every executor.  ``binaryFile`` is no substitute: it leaves out
empty and hidden files and never lists directories.

A directory is listed level by level: the directories of a level are dealt out anew before they are listed, and all files
once more before they are read, so neither a flat directory nor a deep subtree is the work of one task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators.ordering import checkpoint_dir

SCHEMA = "path string, type string, size long, mtime long, blob_id string, content binary"
#: A row that has a file's content has it as a whole; larger files are read in chunks (:mod:`.chunks`).
LARGEST_FILE = 512 << 20
#: Directories that a task lists, and files that it reads.
TASK_DIRS, TASK_FILES, MOST_TASKS = 64, 256, 10_000
#: Files and bytes that a task passes on at once, bytes of a file that are hashed at once, and directories that it remembers.
ROWS_AT_ONCE, BYTES_AT_ONCE, PIECE, KNOWN = 1_000, 4 << 20, 1 << 20, 65_536


class ScanError(Exception):
    """The root is no directory, or a file can't be held in a row."""


def _ignored(name: str, ignore: tuple[str, ...]) -> bool:
    return any(name.startswith(p) for p in ignore)


def dealt(rows: DataFrame, count: int, each: int) -> DataFrame:
    """Rows of a ``path`` over as many tasks as they take, however few bytes they have.

    Beyond four times the tasks of a shuffle, a task has up to eight times as many rows, since each costs a start.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, min(-(-count // each), 4 * least), -(-count // (8 * each)))
    return rows.repartition(min(MOST_TASKS, parts), "path")


def gathered(rows: DataFrame) -> DataFrame:
    """Rows that many tasks have made, in no more parts than a shuffle has: what they say of a file is small."""
    return rows.coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], weight: int) -> Iterator[pa.RecordBatch]:
    """``rows`` as Arrow batches; the column at ``weight`` has what is large in them."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if len(held) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            yield _batch(held, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds.values())], names=list(kinds))


def _entries(root: str, ignore: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for directory in batch.column("path").to_pylist():
                found = []
                try:
                    with os.scandir(os.path.join(root, directory)) as entries:
                        for e in entries:
                            if not _ignored(e.name, ignore) and not e.is_symlink():
                                kind = "directory" if e.is_dir() else "file" if e.is_file() else None
                                if kind:
                                    found.append((f"{directory}/{e.name}" if directory else e.name, kind))
                            if len(found) >= 10_000:
                                yield _listed(found)
                                found = []
                except FileNotFoundError:  # gone since it was listed
                    pass
                yield _listed(found)

    return run


def _listed(found: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["path", "type"])


def listing(spark: SparkSession, root: str, ignore: tuple[str, ...] | None = paths.DEFAULT_IGNORE, max_depth: int | None = None) -> DataFrame:
    """``path``, ``type`` of the files and directories below ``root``, without links; what is ignored isn't listed either."""
    root = str(root)
    if not os.path.isdir(root):
        raise ScanError(f"not a directory: {root}")
    checkpoint_dir(spark)
    found = spark.createDataFrame([], "path string, type string")
    frontier, count, level = spark.createDataFrame([("",)], "path string"), 1, 0
    while count and (max_depth is None or level < max_depth):
        level += 1
        here = dealt(frontier, count, TASK_DIRS).mapInArrow(_entries(root, tuple(ignore or ())), "path string, type string").checkpoint()
        found = found.unionByName(here)
        frontier = here.where("type = 'directory'").select("path")
        count = frontier.count()
    return found


_READ = {"path": pa.string(), "type": pa.string(), "size": pa.int64(), "mtime": pa.int64(), "blob_id": pa.string(), "content": pa.binary()}


def content_hash(full: str) -> str:
    """The SHA-256 of a file, of which a piece is held."""
    digest = hashlib.sha256()
    with open(full, "rb", buffering=0) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def _reader(root: str, content: bool, hashed: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                full = os.path.join(root, path)
                try:
                    stat = os.stat(full, follow_symlinks=False)
                    if content and stat.st_size > LARGEST_FILE:
                        raise ScanError(f"{path} has {stat.st_size} bytes, more than a row holds; read it in chunks")
                    data = Path(full).read_bytes() if content else None
                    digest = hashlib.sha256(data).hexdigest() if content else content_hash(full) if hashed else None
                except FileNotFoundError:
                    continue
                yield path, "file", stat.st_size, stat.st_mtime_ns // 1_000_000, digest, data

    return lambda batches: in_batches(read(batches), _READ, 5)


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] | None = paths.DEFAULT_IGNORE, max_depth: int | None = None, content: bool = True, hashed: bool = False) -> DataFrame:
    """Files and directories below ``root``, listed now and read when the result is; ``ignore`` None leaves nothing out.

    Without ``content`` files aren't opened, unless they are to be ``hashed``: then a file of any size has its blob id.
    """
    found = listing(spark, root, ignore, max_depth)
    files = found.where("type = 'file'").select("path")
    none = {"size": "long", "mtime": "long", "blob_id": "string", "content": "binary"}
    dirs = found.where("type = 'directory'").select("path", "type", *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    return dirs.unionByName(dealt(files, files.count(), TASK_FILES).mapInArrow(_reader(str(root), content, hashed), SCHEMA))


def contents(files: DataFrame, root: str, stored: DataFrame) -> DataFrame:
    """``blob_id``, ``content`` of the blobs of scanned ``files`` that ``stored`` lacks, each read from one of the files that hold it.

    A content that isn't there any more, since its file has changed, is an error.
    """
    one = files.groupBy("blob_id").agg(F.min(F.struct("path", "size")).alias("at"))
    lacking = one.join(stored.select("blob_id"), "blob_id", "left_anti").select("blob_id", "at.path", "at.size").checkpoint()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for blob_id, path, size in zip(*(batch.column(c).to_pylist() for c in ("blob_id", "path", "size"))):
                if size > LARGEST_FILE:
                    raise ScanError(f"{path} has {size} bytes, more than a row holds; read it in chunks")
                data = Path(os.path.join(root, path)).read_bytes()
                if hashlib.sha256(data).hexdigest() != blob_id:
                    raise ScanError(f"{path} has changed since it was listed")
                yield blob_id, data

    parts = max(-(-(lacking.agg(F.sum("size")).first()[0] or 0) // (64 << 20)), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = {"blob_id": pa.string(), "content": pa.binary()}
    return lacking.repartition(min(MOST_TASKS, parts), "path").mapInArrow(lambda batches: in_batches(read(batches), kinds, 1), "blob_id string, content binary")


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files, ignored ones too; nothing for a directory that can't be read."""
    try:
        return listing(spark, root, None).where("type = 'file'").select("path")
    except (ScanError, OSError):
        return spark.createDataFrame([], "path string")


def file_to_blob(spark: SparkSession, path: str, include_path: bool = True) -> DataFrame:
    """A single file: ``name``, ``blob_id``, ``size``, ``mtime``, ``path`` (empty unless asked for), ``content``."""
    return files_to_blobs(spark, [path], include_path)


def files_to_blobs(spark: SparkSession, files: list[str], include_path: bool = True) -> DataFrame:
    """Files in the given order (``place``), read by the executors."""

    def read(rows: Iterator[Row]) -> Iterator[tuple]:
        for place, path in rows:
            stat, data = os.stat(path), Path(path).read_bytes()
            yield place, os.path.basename(path), hashlib.sha256(data).hexdigest(), stat.st_size, stat.st_mtime_ns // 1_000_000, path if include_path else "", data

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame(list(read(zip(batch.place, batch.path))), columns=["place", "name", "blob_id", "size", "mtime", "path", "content"])

    listed = spark.createDataFrame(list(enumerate(map(str, files))), "place long, path string")
    return listed.mapInPandas(run, "place long, name string, blob_id string, size long, mtime long, path string, content binary")


def missing_blobs(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files of a tree whose blob isn't stored."""
    return tree.where("type = 'file' AND blob_id IS NOT NULL").join(blobs.select("blob_id"), "blob_id", "left_anti")


class RestoreError(Exception):
    """A tree can't be written: a blob is missing, or a file stands where a directory must be."""


def write_tree(tree: DataFrame, blobs: DataFrame, target: str, chunks: tuple[DataFrame, DataFrame] | None = None) -> None:
    """Writes directories and files of ``tree`` (``path``, ``type``, ``blob_id``, ``mtime``) below ``target``.

    Each file goes to a temporary name and is then moved, so a task that runs twice leaves the same file.  A file without
    a blob id and entries of another type are left out.  Blobs may also be in ``chunks``: their list and the chunks.
    """
    checkpoint_dir(tree.sparkSession)
    tree = tree.select("path", "type", "blob_id", "mtime").checkpoint()
    missing = missing_blobs(tree, blobs).select("path", "blob_id", "mtime")
    lost = (missing if chunks is None else missing.join(chunks[0].select("blob_id"), "blob_id", "left_anti")).select("path").take(1)
    if lost:
        raise RestoreError(f"no blob for {lost[0]['path']}")
    make_dirs(tree.where("type = 'directory'").select("path"), target)
    files = tree.where("type = 'file' AND blob_id IS NOT NULL").select("path", "blob_id", "mtime").join(blobs.select("blob_id", "content"), "blob_id")
    _write_files(files, target)
    if chunks is not None:
        from sylva.sources import chunks as chunked

        chunked.write(missing, *chunks, target)


def make_dirs(dirs: DataFrame, target: str) -> None:
    """Makes the directories ``path`` below ``target``."""
    os.makedirs(target, exist_ok=True)
    dirs.select("path").foreachPartition(lambda rows: [_make_dir(target, r["path"]) for r in rows])


def _write_files(files: DataFrame, target: str, create_dirs: bool = True) -> None:
    """Writes files (``path``, ``mtime``, ``content``), each by a task and in one move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            for path, mtime, content in zip(*(batch.column(c) for c in ("path", "mtime", "content"))):
                _write_file(target, {"path": path.as_py(), "mtime": mtime.as_py(), "content": content.as_py()}, create_dirs, known)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    files.select("path", "mtime", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()


def write_partly(tree: DataFrame, blobs: DataFrame, target: str, chunks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Writes what can be written of a tree; ``path``, ``error`` of what can't, each entry by itself."""
    os.makedirs(target, exist_ok=True)
    lost = missing_blobs(tree, blobs).select("path", "blob_id", "mtime")
    held = tree.where("type = 'file' AND blob_id IS NOT NULL").select("path", "blob_id", "mtime").join(blobs.select("blob_id", "content"), "blob_id")
    rows = tree.where("type = 'directory'").select("path", "type", F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("binary").alias("content"))
    rows = rows.unionByName(held.select("path", F.lit("file").alias("type"), "mtime", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = []
            for path, kind, mtime, content in zip(*(batch.column(c) for c in ("path", "type", "mtime", "content"))):
                row = Row(path=path.as_py(), mtime=mtime.as_py(), content=content.as_py())
                try:
                    _make_dir(target, row["path"]) if kind.as_py() == "directory" else _write_file(target, row)
                except (RestoreError, OSError) as e:
                    failed.append((row["path"], str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in failed], pa.string()) for k in (0, 1)], names=["path", "error"])

    failures = rows.mapInArrow(run, "path string, error string").checkpoint()
    if chunks is not None:
        from sylva.sources import chunks as chunked

        whole = chunks[0].join(chunks[1].select("chunk_id", F.lit(1).alias("held")), "chunk_id", "left").groupBy("blob_id").agg((F.count("*") == F.count("held")).alias("whole")).where("whole")
        chunked.write(lost.join(whole, "blob_id", "left_semi"), *chunks, target)
        lost = lost.join(whole, "blob_id", "left_anti")
    return failures.unionByName(lost.select("path", F.concat(F.lit("no blob "), "blob_id").alias("error")))


def _inside(target: str, path: str) -> str:
    full, root = os.path.normpath(os.path.join(target, path)), os.path.realpath(target)
    # a link inside the target mustn't lead out of it either
    above = os.path.realpath(os.path.dirname(full) if full != os.path.normpath(target) else full)
    if not (full + os.sep).startswith(os.path.normpath(target) + os.sep) or not (above + os.sep).startswith(root + os.sep):
        raise RestoreError(f"{path} leaves the target")
    return full


def _make_dir(target: str, path: str) -> None:
    try:
        os.makedirs(_inside(target, path), exist_ok=True)
    except (FileExistsError, NotADirectoryError) as e:
        raise RestoreError(f"a file stands at or above {path}") from e


def _write_file(target: str, row: Row | dict, create_dirs: bool = True, known: set[str] | None = None) -> None:
    """``known``: directories that the same task has found inside the target, and so needn't look at again."""
    clean = os.path.normpath(row["path"])
    above = os.path.dirname(clean)
    seen = known is not None and above in known
    path = os.path.join(os.path.normpath(target), clean) if seen else _inside(target, row["path"])
    if os.path.isdir(path):
        raise RestoreError(f"a directory stands at {row['path']}")
    if not seen:
        if create_dirs:
            _make_dir(target, os.path.dirname(row["path"]) or ".")
        elif not os.path.isdir(os.path.dirname(path)):
            raise RestoreError(f"there is no directory for {row['path']}")
        if known is not None:
            if len(known) >= KNOWN:
                known.clear()
            known.add(above)
    temporary = os.path.join(os.path.dirname(path), f".sylva-tmp-{os.getpid()}-{os.path.basename(path)}")
    with open(temporary, "wb") as f:
        f.write(row["content"])
    if row["mtime"] is not None:
        os.utime(temporary, ns=(row["mtime"] * 1_000_000,) * 2)
    os.replace(temporary, path)


def restore(spark: SparkSession, tree: DataFrame, blobs: DataFrame, target: str, clean: bool = False, keep_ignored: tuple[str, ...] = (), chunks: tuple[DataFrame, DataFrame] | None = None) -> None:
    """Writes a tree and, with ``clean``, removes what isn't part of it.

    Only files that were there before are removed, so one that appears meanwhile stays, and directories only once
    empty.  ``keep_ignored`` patterns are spared; by default nothing is.
    """
    from sylva.operators import restore as plans

    before = all_files(spark, target).checkpoint() if clean and os.path.isdir(target) else None
    write_tree(tree, blobs, target, chunks)
    if before is None:
        return
    entries = tree.select("path", F.when(F.col("type") == "directory", paths.DIR_MARKER).otherwise(F.coalesce("blob_id", F.lit(""))).alias("blob_id")).where(F.col("path") != paths.ROOT)
    expected = plans.expected_paths(entries)
    present = all_files(spark, target)
    gone = plans.prune_files(present, before, expected)
    if keep_ignored:
        gone = gone.where(~paths.any_segment_ignored(F.col("path"), keep_ignored))
    gone.foreachPartition(lambda rows: [os.remove(_inside(target, r["path"])) for r in rows if os.path.lexists(_inside(target, r["path"]))])
    keep = expected.where("kind = 'directory'").select("path")
    dirs = listing(spark, target, None).where("type = 'directory'").select("path", paths.depth(F.col("path")).alias("depth")).join(keep, "path", "left_anti").checkpoint()
    deepest = dirs.agg(F.max("depth").alias("d")).first()["d"]
    for depth in range(deepest or 0, 0, -1):
        dirs.where(F.col("depth") == depth).foreachPartition(lambda rows: [_remove_if_empty(_inside(target, r["path"])) for r in rows])


def _remove_if_empty(full: str) -> None:
    if os.path.isdir(full) and not os.listdir(full):
        os.rmdir(full)


def copy_directory(spark: SparkSession, source: str, target: str) -> None:
    """One-shot copy of a directory into another."""
    found = scan(spark, source)
    restore(spark, found, found.where("type = 'file'").select("blob_id", "content").dropDuplicates(["blob_id"]), target)


def blobs_to_files(blobs: DataFrame, target: str, create_dirs: bool = True, preserve_mtime: bool = True) -> None:
    """Writes blobs (``path``, ``content``, ``mtime``) below ``target``, each file by a task and in one move.

    Of several rows of one path the last in ``place`` is written, if there is such a column.  Without ``create_dirs`` a
    missing directory is an error; without ``preserve_mtime`` files have the time of writing.
    """
    from sylva.operators import restore as plans

    rows = plans.last_by_name(blobs, "path", "place") if "place" in blobs.columns else blobs
    mtime = F.col("mtime") if preserve_mtime and "mtime" in rows.columns else F.lit(None).cast("long")
    if create_dirs:
        os.makedirs(target, exist_ok=True)
    _write_files(rows.select("path", mtime.alias("mtime"), "content"), target, create_dirs)


def blob_to_file(blobs: DataFrame, blob_id: str, target: str, path: str, create_dirs: bool = True, mtime: int | None = None) -> None:
    """Writes one stored blob to ``path`` below ``target``."""
    row = blobs.where(F.col("blob_id") == blob_id).select(F.lit(path).alias("path"), F.lit(mtime).cast("long").alias("mtime"), "content").limit(1)
    if row.isEmpty():
        raise LookupError(f"no blob {blob_id}")
    blobs_to_files(row, target, create_dirs)
