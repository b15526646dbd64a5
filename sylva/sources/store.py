"""Snapshots in Parquet: ``nodes``, ``blobs``, ``chunks`` and ``history``, each appended to.

A blob is held in one row, or, stored by :meth:`Store.put_directory`, in chunks.  Nodes, blobs and chunks are keyed by content, so storing a tree twice adds nothing.  The history row is written last and
makes the snapshot: a run that fails before it leaves rows that the next one reuses.

Every append adds files.  :meth:`Store.compact` gathers them into a generation of files that are dealt and sorted by key, in a
folder for each first digits of the keys, with Bloom filters, so that a lookup by key opens the files of one folder and those
appended since.  A generation counts once its row is in the table ``generations``, which also names the files it has taken in.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators import history as revisions
from sylva.operators import nodes as tree_nodes
from sylva.operators.ordering import checkpoint_dir
from sylva.sources import chunks as chunked
from sylva.sources import directory

NODES = "hash string, path string, name string, type string, is_parent boolean, n_children long, size long, blob_id string, mtime long"
EDGES = "parent_hash string, hash string, pos long"
BLOBS = "blob_id string, content binary"
CHUNKS, BLOB_CHUNKS = "chunk_id string, content binary", "blob_id string, pos long, chunk_id string, start long, size long"
ERRORS = "ts timestamp, context string, path string, error string"
HISTORY = "tree string, time_id string, ref string, route string, origin string, client_ts long, previous array<string>"


GENERATIONS = "name string, generation long, digits int, taken array<string>"
#: Tables that are looked up by a hexadecimal key.
KEYS = {"nodes": "hash", "blobs": "blob_id", "chunks": "chunk_id"}
#: Rows of a compacted file, as far as ranges allow.
FILE_ROWS = {"nodes": 1_000_000, "blobs": 20_000, "chunks": 2_000}


class Store:
    """Tables under ``path``, a folder that all executors see; one ``tree`` key for each tree."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, schema: str, *files: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _generation(self, name: str) -> tuple[int, int, list[str]]:
        """The table's last generation (0: none), the digits that its folders have, and the files that it has taken in."""
        found = self._read(GENERATIONS, f"{self.path}/generations").where(F.col("name") == name).orderBy(F.desc("generation")).first()
        return (found["generation"], found["digits"], found["taken"]) if found else (0, 0, [])

    def _table(self, name: str, schema: str, key: str | None = None) -> DataFrame:
        """A table, or its rows of one ``key``."""
        number, digits, taken = self._generation(name) if name in KEYS else (0, 0, [])
        appended = self._read(schema, f"{self.path}/{name}")
        if number:
            known = set(taken)
            appended = self._read(schema, *(f for f in appended.inputFiles() if os.path.basename(f) not in known))
        if key is not None:
            appended = appended.where(F.col(KEYS[name]) == key)
        if not number:
            return appended
        whole = self._read(f"{schema}, digits string", f"{self.path}/{name}-{number}")
        if key is not None:
            whole = whole.where((F.col("digits") == key[:digits]) & (F.col(KEYS[name]) == key))
        return whole.drop("digits").unionByName(appended)

    def compact(self, *names: str, digits: int = 2) -> None:
        """Gathers all files of the tables (by default of all that have keys) into a new generation.

        Keys of a folder have their first ``digits`` in common: 16 to that power is the number of folders.

        Rows that were stored twice are kept once.  Files that the last generation had taken in, and the generation before
        it, are removed: whoever still reads with them began before that.  Nothing may be appended meanwhile by others.
        """
        for name in names or KEYS:
            schema, key = {"nodes": NODES, "blobs": BLOBS, "chunks": CHUNKS}[name], KEYS[name]
            files = self._read(schema, f"{self.path}/{name}").inputFiles()
            if not files:
                continue
            number, _, taken = self._generation(name)
            rows = self._table(name, schema).dropDuplicates([key]).withColumn("digits", F.left(key, F.lit(digits)))
            parts = max(1, -(-self._table(name, schema).count() // FILE_ROWS[name]))
            writer = rows.repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").partitionBy("digits")
            writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(FILE_ROWS[name])).parquet(f"{self.path}/{name}-{number + 1}")
            row = [(name, number + 1, digits, [os.path.basename(f) for f in files])]
            self.spark.createDataFrame(row, GENERATIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
            self._remove(*(f for f in files if os.path.basename(f) in set(taken)), f"{self.path}/{name}-{number - 1}")

    def _remove(self, *paths_: str) -> None:
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        for p in paths_:
            path = hadoop.Path(p)
            path.getFileSystem(conf).delete(path, True)

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes", NODES)

    def node(self, hash_: str) -> DataFrame:
        """The node of a hash, if it is stored."""
        return self._table("nodes", NODES, hash_)

    @property
    def edges(self) -> DataFrame:
        return self._table("edges", EDGES)

    @property
    def blobs(self) -> DataFrame:
        return self._table("blobs", BLOBS)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    @property
    def blob_chunks(self) -> DataFrame:
        return self._table("blob_chunks", BLOB_CHUNKS)

    @property
    def errors(self) -> DataFrame:
        """What failed, as :meth:`record` has written it."""
        return self._table("errors", ERRORS)

    def record(self, context: str, failures: DataFrame) -> int:
        """Appends ``failures`` (``path``, ``error``) to the table of errors; how many there are."""
        rows = failures.select(F.current_timestamp().alias("ts"), F.lit(context).alias("context"), "path", "error").checkpoint()
        count = rows.count()
        if count:
            rows.write.mode("append").parquet(f"{self.path}/errors")
        return count

    def history(self, tree: str) -> DataFrame:
        return self._table("history", HISTORY).where(F.col("tree") == tree)

    def blob(self, blob_id: str) -> bytes:
        row = self._table("blobs", BLOBS, blob_id).first()
        if row is not None:
            return bytes(row["content"])
        if not self.has_blob(blob_id):
            raise LookupError(f"no blob {blob_id}")
        return b"".join(chunked.read(self.blob_chunks, self.chunks, blob_id))

    def has_blob(self, blob_id: str) -> bool:
        lists = self.blob_chunks.where(F.col("blob_id") == blob_id).select("blob_id")
        return not self._table("blobs", BLOBS, blob_id).select("blob_id").unionByName(lists).isEmpty()

    def put(self, entries: DataFrame, tree: str, previous: list[str] | None = None, origin: str | None = None, client_ts: int | None = None) -> tuple[str, str]:
        """Stores scanned ``entries`` (with ``content``) as a revision of ``tree``: its ref (the root's hash) and its id."""
        check_key(tree)
        files = entries.where("type = 'file'")
        stored = self.blobs.select("blob_id")
        files.select("blob_id", "content").dropDuplicates(["blob_id"]).join(stored, "blob_id", "left_anti").write.mode("append").parquet(f"{self.path}/blobs")
        checkpoint_dir(self.spark)
        # kept without contents, as entries may be read from their files each time they are asked for
        known = entries.select("path", "type", "blob_id", "size", "mtime").checkpoint()
        ref = self._put_nodes(known.where("type = 'file'"), known.where("type = 'directory'").select("path"))
        return ref, self.add_revision(tree, ref, previous, origin, client_ts)

    def put_files(self, root: str, tree: str, previous: list[str] | None = None, origin: str | None = None, client_ts: int | None = None, ignore: tuple[str, ...] | None = paths.DEFAULT_IGNORE) -> tuple[str, str]:
        """Stores a directory, a row for each different content: its ref and the revision's id.

        Contents are read once to be told apart, and new ones once more to be stored; they aren't shuffled.
        """
        check_key(tree)
        found = directory.gathered(directory.scan(self.spark, root, ignore, content=False, hashed=True).drop("content").checkpoint())
        files = found.where("type = 'file'")
        directory.contents(files, root, self.blobs).write.mode("append").parquet(f"{self.path}/blobs")
        ref = self._put_nodes(files, found.where("type = 'directory'").select("path"))
        return ref, self.add_revision(tree, ref, previous, origin, client_ts)

    def put_directory(self, root: str, tree: str, previous: list[str] | None = None, origin: str | None = None, client_ts: int | None = None, ignore: tuple[str, ...] | None = paths.DEFAULT_IGNORE, sizes: chunked.Sizes = chunked.Sizes()) -> tuple[str, str]:
        """Stores a directory of files of any size, in chunks: its ref and the revision's id.

        Contents are read once to be cut, and those of new chunks once more to be stored.
        """
        check_key(tree)
        dirs, files = chunked.describe(self.spark, root, ignore, sizes)
        chunked.contents(files, root, self.chunks).write.mode("append").parquet(f"{self.path}/chunks")
        # a blob's list of chunks makes it readable, so it comes after them
        chunked.blob_chunks(files).join(self.blob_chunks.select("blob_id").distinct(), "blob_id", "left_anti").write.mode("append").parquet(f"{self.path}/blob_chunks")
        ref = self._put_nodes(files, dirs)
        return ref, self.add_revision(tree, ref, previous, origin, client_ts)

    def _put_nodes(self, files: DataFrame, dirs: DataFrame) -> str:
        found = tree_nodes.merkle_nodes(files.select("path", "blob_id", "size", "mtime"), dirs).checkpoint()
        ref = found.where(F.col("path") == paths.ROOT).first()["hash"]
        hashes = found.select(F.col("path").alias("parent_path"), F.col("hash").alias("parent_hash"))
        edges = tree_nodes.children(found).join(hashes, "parent_path").select("parent_hash", "hash", "pos").distinct()
        edges.join(self.edges.select("parent_hash").distinct(), "parent_hash", "left_anti").write.mode("append").parquet(f"{self.path}/edges")
        tree_nodes.new_nodes(found, self.nodes).select("hash", *(c for c in found.columns if c != "hash")).write.mode("append").parquet(f"{self.path}/nodes")
        return ref

    def add_revision(self, tree: str, ref: str, previous: list[str] | None = None, origin: str | None = None, client_ts: int | None = None) -> str:
        now = time.time_ns()
        time_id = f"{now:020d}"
        row = [(tree, time_id, ref, f"/{tree}", origin, client_ts if client_ts is not None else now // 1_000_000, previous or [])]
        self.spark.createDataFrame(row, HISTORY).coalesce(1).write.mode("append").parquet(f"{self.path}/history")
        return time_id

    def get(self, ref: str) -> DataFrame:
        """Nodes of a stored tree with their ``level``; blank and unknown refs are errors."""
        return tree_nodes.fetch_tree(self.nodes, self.edges, ref)

    def load(self, ref: str, target: str, clean: bool = False) -> None:
        """Writes a stored tree to a directory."""
        tree = self.get(ref).where(F.col("path") != paths.ROOT)
        directory.restore(self.spark, tree, self.blobs, target, clean, chunks=(self.blob_chunks, self.chunks))

    def load_partly(self, ref: str, target: str) -> int:
        """:meth:`load` of whatever can be written; what can't becomes rows of :attr:`errors`, which are counted.

        These are nodes that an edge names but that aren't stored, files whose content isn't, and files that can't be
        written, each with its reason.
        """
        tree = self.get(ref).checkpoint()
        hashes = tree.select(F.col("hash").alias("parent_hash"), F.col("path").alias("above"))
        named = self.edges.join(hashes, "parent_hash").select("hash", "above").distinct()
        gone = named.join(self.nodes.select("hash"), "hash", "left_anti").select(F.col("above").alias("path"), F.concat(F.lit("no node "), "hash").alias("error"))
        failed = directory.write_partly(tree.where(F.col("path") != paths.ROOT), self.blobs, target, (self.blob_chunks, self.chunks))
        return self.record(f"load {ref}", gone.unionByName(failed))

    def holds(self, ref: str) -> bool:
        """Whether a tree is stored: its nodes are written after all else."""
        return not self.node(ref).isEmpty()

    def versions(self, tree: str) -> DataFrame:
        return self.history(tree).orderBy("time_id")

    def forks(self, tree: str) -> DataFrame:
        return revisions.tips(self.history(tree))


def read_through(local: Store, peer: Store, ref: str) -> DataFrame:
    """The nodes of a tree from ``local``; what it lacks is fetched from ``peer`` first and stored, contents before nodes.

    A tree that ``local`` holds is read without ``peer``.
    """
    if not local.holds(ref):
        tree = peer.get(ref).checkpoint()
        wanted = tree.where("blob_id is not null").select("blob_id").distinct()
        peer.blobs.join(wanted, "blob_id", "left_semi").join(local.blobs.select("blob_id"), "blob_id", "left_anti").write.mode("append").parquet(f"{local.path}/blobs")
        lists = peer.blob_chunks.join(wanted, "blob_id", "left_semi").join(local.blob_chunks.select("blob_id").distinct(), "blob_id", "left_anti").checkpoint()
        peer.chunks.join(lists.select("chunk_id").distinct(), "chunk_id", "left_semi").join(local.chunks.select("chunk_id"), "chunk_id", "left_anti").write.mode("append").parquet(f"{local.path}/chunks")
        lists.write.mode("append").parquet(f"{local.path}/blob_chunks")
        edges = peer.edges.join(tree.select(F.col("hash").alias("parent_hash")).distinct(), "parent_hash", "left_semi")
        edges.join(local.edges.select("parent_hash").distinct(), "parent_hash", "left_anti").write.mode("append").parquet(f"{local.path}/edges")
        tree_nodes.new_nodes(tree.drop("level"), local.nodes).select(*local.nodes.columns).write.mode("append").parquet(f"{local.path}/nodes")
    return local.get(ref)


def check_key(tree: str) -> None:
    if not tree.endswith("Tree"):
        raise ValueError(f'the key of a tree ends in "Tree": {tree}')
