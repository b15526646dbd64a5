"""Files of any size in content-defined chunks.

A chunk ends where a rolling hash of the last bytes has zeros in given places, so an insertion moves few borders, and files
that share a passage share its chunks.  A file is read in pieces by one task that holds no more than a piece and a
chunk of it; what goes through Spark is a row for each chunk.  The contents of chunks that aren't stored yet are read in
a second pass, over many tasks however large their file is, and written back likewise, each chunk to its place.

Tables: ``blob_chunks`` (``blob_id``, ``pos``, ``chunk_id``, ``start``, ``size``) and ``chunks`` (``chunk_id``, ``content``).  A blob's id is
the SHA-256 of its content, as for blobs in one row, a chunk's that of its own; ``merkle`` is the hash of a blob's chunk ids.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators.ordering import checkpoint_dir
from sylva.sources import directory

#: Bytes that a border depends on; bytes of a file that are read at once; bytes of files that are cut in one go.
WINDOW, PIECE, TOGETHER = 32, 8 << 20, 1 << 20
FILES = "path string, size long, mtime long, blob_id string, merkle string, chunks array<struct<pos:long,chunk_id:string,start:long,size:long>>"


class ChunkError(Exception):
    """A chunk isn't stored, or a file has changed since it was listed."""


@dataclass(frozen=True)
class Sizes:
    """Least, usual (a power of two) and most bytes of a chunk."""

    least: int = 16 << 10
    usual: int = 64 << 10
    most: int = 256 << 10

    def __post_init__(self):
        if not WINDOW <= self.least <= self.most or self.usual & (self.usual - 1):
            raise ValueError(f"no such sizes of chunks: {self}")


def _byte_values() -> np.ndarray:
    """A number for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_VALUES = _byte_values()


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the ``WINDOW`` bytes up to and with each byte: their values, each shifted by its distance, added up.

    Sums of twice as many bytes are made of two of half as many.
    """
    h, width = _VALUES[data], 1
    while width < WINDOW:
        h = h.copy()
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def borders(data: bytes, sizes: Sizes) -> np.ndarray:
    """Where chunks may end.  From ``WINDOW`` bytes on, no border depends on what stands before a file's first byte."""
    mask = np.uint32((sizes.usual - 1) << (32 - (sizes.usual - 1).bit_length())) if sizes.usual > 1 else np.uint32(0)
    return np.flatnonzero((rolling(np.frombuffer(data, np.uint8)) & mask) == 0) + 1 if data else np.empty(0, np.int64)


def spans(ends: list[int], start: int, stop: int, sizes: Sizes) -> Iterator[tuple[int, int]]:
    """The chunks from ``start`` that end at ``stop`` at the latest, as far as they are known without what comes after."""
    while True:
        k = bisect_left(ends, start + sizes.least)
        end = min(ends[k] if k < len(ends) else stop + 1, start + sizes.most)
        if end > stop:
            break
        yield start, end
        start = end


class Chunker:
    """Cuts a file that is fed in pieces; the chunks don't depend on how it is cut into pieces."""

    def __init__(self, sizes: Sizes):
        self.sizes, self.held = sizes, b""

    def feed(self, piece: bytes, last: bool = False) -> Iterator[bytes]:
        data, at = self.held + piece, 0
        for start, at in spans(borders(data, self.sizes).tolist(), 0, len(data), self.sizes):
            yield data[start:at]
        self.held = data[at:]
        if last and self.held:
            yield self.held
            self.held = b""


def cut(file: Iterator[bytes], sizes: Sizes) -> Iterator[bytes]:
    chunker = Chunker(sizes)
    for piece in file:
        yield from chunker.feed(piece)
    yield from chunker.feed(b"", last=True)


def cut_together(files: list[bytes], sizes: Sizes) -> Iterator[list[bytes]]:
    """The chunks of each of some small files, whose borders are found in one go."""
    data, start = b"".join(files), 0
    ends = borders(data, sizes).tolist()
    for file in files:
        stop, found = start + len(file), []
        for start, at in spans(ends, start, stop, sizes):
            found.append(data[start:at])
            start = at
        if start < stop:
            found.append(data[start:stop])
        yield found
        start = stop


def _or_empty(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """An empty file has one empty chunk, so that its blob has a row."""
    first = next(chunks, b"")
    yield first
    yield from chunks


def _pieces(full: str) -> Iterator[bytes]:
    with open(full, "rb") as f:
        while piece := f.read(PIECE):
            yield piece


_CHUNK = {"pos": pa.int64(), "chunk_id": pa.string(), "start": pa.int64(), "size": pa.int64()}
_FILE = {"path": pa.string(), "size": pa.int64(), "mtime": pa.int64(), "blob_id": pa.string(), "merkle": pa.string()}


class _Description:
    """Rows of files and their chunks, column by column."""

    def __init__(self):
        self.files, self.chunks, self.offsets = {c: [] for c in _FILE}, {c: [] for c in _CHUNK}, [0]

    def add(self, path: str, mtime: int, chunks: Iterator[bytes]) -> None:
        whole, tree, start, n = hashlib.sha256(), hashlib.sha256(), 0, 0
        c = self.chunks
        for chunk in chunks:
            own = hashlib.sha256(chunk)
            whole.update(chunk)
            tree.update(own.digest())
            for name, value in (("pos", n), ("chunk_id", own.hexdigest()), ("start", start), ("size", len(chunk))):
                c[name].append(value)
            start, n = start + len(chunk), n + 1
        self.offsets.append(self.offsets[-1] + n)
        for name, value in zip(_FILE, (path, start, mtime, whole.hexdigest(), tree.hexdigest())):
            self.files[name].append(value)

    def batch(self) -> pa.RecordBatch:
        parts = pa.StructArray.from_arrays([pa.array(self.chunks[n], k) for n, k in _CHUNK.items()], names=list(_CHUNK))
        lists = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), parts)
        return pa.RecordBatch.from_arrays([*(pa.array(self.files[n], k) for n, k in _FILE.items()), lists], names=[*_FILE, "chunks"])


def _described(root: str, sizes: Sizes):
    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, bytes | None]]]:
        """Files with their contents, as many as are cut together; a larger one by itself and without its content."""
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        stat = os.fstat(f.fileno())
                        data = f.read(TOGETHER) if stat.st_size < TOGETHER else None
                except FileNotFoundError:  # gone since it was listed
                    continue
                mtime = stat.st_mtime_ns // 1_000_000
                if data is None or len(data) == TOGETHER:
                    yield [(path, mtime, None)]
                    continue
                held.append((path, mtime, data))
                size += len(data)
                if size >= TOGETHER or len(held) >= directory.ROWS_AT_ONCE:
                    yield held
                    held, size = [], 0
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in small(batches):
            told = _Description()
            if len(held) == 1 and held[0][2] is None:
                path, mtime, _ = held[0]
                try:
                    told.add(path, mtime, _or_empty(cut(_pieces(os.path.join(root, path)), sizes)))
                except FileNotFoundError:
                    continue
            else:
                for (path, mtime, _), chunks in zip(held, cut_together([data for _, _, data in held], sizes)):
                    told.add(path, mtime, chunks or [b""])  # an empty file has one empty chunk, so that its blob has a row
            yield told.batch()

    return run


def describe(spark: SparkSession, root: str, ignore: tuple[str, ...] | None = paths.DEFAULT_IGNORE, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """The directories below ``root`` (``path``), and its files with their chunks but without contents."""
    found = directory.listing(spark, root, ignore)
    files = found.where("type = 'file'").select("path")
    described = directory.dealt(files, files.count(), directory.TASK_FILES).mapInArrow(_described(str(root), sizes), FILES).checkpoint()
    return found.where("type = 'directory'").select("path"), directory.gathered(described)


def blob_chunks(files: DataFrame) -> DataFrame:
    """The chunks of each different blob."""
    one = files.groupBy("blob_id").agg(F.min_by("chunks", "path").alias("chunks"))
    return one.select("blob_id", F.explode("chunks").alias("c")).select("blob_id", "c.pos", "c.chunk_id", "c.start", "c.size")


def contents(files: DataFrame, root: str, stored: DataFrame) -> DataFrame:
    """``chunk_id``, ``content`` of the chunks that ``stored`` lacks, each read from one of the files that hold it.

    A chunk that isn't there any more, since its file has changed, is an error.
    """
    every = files.select("path", F.explode("chunks").alias("c")).select("path", "c.chunk_id", "c.start", "c.size")
    one = every.groupBy("chunk_id").agg(F.min(F.struct("path", "start", "size")).alias("at"))
    lacking = one.join(stored.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "at.path", "at.start", "at.size").checkpoint()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        file, of = None, None
        try:
            for batch in batches:
                for chunk_id, path, start, size in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "path", "start", "size"))):
                    if path != of:
                        if file is not None:
                            file.close()
                        file, of = open(os.path.join(root, path), "rb"), path
                    file.seek(start)
                    content = file.read(size)
                    if hashlib.sha256(content).hexdigest() != chunk_id:
                        raise ChunkError(f"{path} has changed since it was listed")
                    yield chunk_id, content
        finally:
            if file is not None:
                file.close()

    kinds = {"chunk_id": pa.string(), "content": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return directory.in_batches(read(batches), kinds, 1)

    # by ranges of the files' bytes, so that a task reads on where it was
    parts = max(1, -(-(lacking.agg(F.sum("size")).first()[0] or 0) // (64 << 20)), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return lacking.repartitionByRange(min(directory.MOST_TASKS, parts), "path", "start").sortWithinPartitions("path", "start").mapInArrow(run, "chunk_id string, content binary")


def write(tree: DataFrame, of_blobs: DataFrame, chunks: DataFrame, target: str) -> None:
    """Writes files (``path``, ``blob_id``, ``mtime``) below ``target``, each chunk by the task that has it.

    Chunks go to their places in a temporary file, which is moved once all are there; a task that runs twice writes the
    same bytes to the same places.  A chunk that isn't stored is an error before anything is moved.
    """
    spark = tree.sparkSession
    checkpoint_dir(spark)
    job = uuid.uuid4().hex
    files = tree.select("path", "blob_id", "mtime").checkpoint()
    placed = files.join(of_blobs, "blob_id").join(chunks.withColumnRenamed("content", "held"), "chunk_id", "left")
    rows = placed.select("path", "start", "size", F.coalesce("held", F.raise_error(F.concat(F.lit("no chunk of "), "path")).cast("binary")).alias("content"))

    top = os.path.normpath(target)

    def temporary(path: str) -> str:
        """The place of a file until it is whole; ``begin`` has seen that it lies inside the target."""
        full = os.path.normpath(os.path.join(top, path))
        return os.path.join(os.path.dirname(full), f".sylva-tmp-{job}-{os.path.basename(full)}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, content in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), batch.column("content")):
                handle = os.open(temporary(path), os.O_WRONLY | os.O_CREAT, 0o666)
                try:
                    view = memoryview(content.as_buffer())
                    while view:
                        n = os.pwrite(handle, view, at)
                        view, at = view[n:], at + n
                finally:
                    os.close(handle)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def begin(part) -> None:
        known: set[str] = set()
        for r in part:
            above = os.path.dirname(os.path.normpath(r["path"]))
            if above not in known:
                directory._inside(target, r["path"])
                directory._make_dir(target, os.path.dirname(r["path"]) or ".")
                if len(known) >= directory.KNOWN:
                    known.clear()
                known.add(above)
            if os.path.isdir(os.path.join(top, os.path.normpath(r["path"]))):
                raise directory.RestoreError(f"a directory stands at {r['path']}")
            os.close(os.open(temporary(r["path"]), os.O_WRONLY | os.O_CREAT, 0o666))

    def finish(part) -> None:
        for r in part:
            held = temporary(r["path"])
            try:
                if r["mtime"] is not None:
                    os.utime(held, ns=(r["mtime"] * 1_000_000,) * 2)
                os.replace(held, os.path.normpath(os.path.join(top, r["path"])))
            except FileNotFoundError:  # moved by an attempt of this task that was lost
                continue

    def drop(part) -> None:
        for r in part:
            if os.path.exists(temporary(r["path"])):
                os.remove(temporary(r["path"]))

    os.makedirs(target, exist_ok=True)
    try:
        files.foreachPartition(begin)
        rows.mapInArrow(put, "n long").agg(F.sum("n")).first()
    except Exception:
        files.foreachPartition(drop)
        raise
    files.foreachPartition(finish)


def read(of_blobs: DataFrame, chunks: DataFrame, blob_id: str) -> Iterator[bytes]:
    """The content of a blob, chunk by chunk."""
    rows = of_blobs.where(F.col("blob_id") == blob_id).join(chunks.select("chunk_id", F.col("content").alias("held")), "chunk_id", "left").orderBy("pos").select("held", "chunk_id")
    for r in rows.toLocalIterator():
        if r["held"] is None:
            raise ChunkError(f"no chunk {r['chunk_id']}")
        yield bytes(r["held"])
