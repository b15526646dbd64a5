"""Registered queries that write the documents as files, scan them, store them and restore them.

Directories lie in the folder that the cluster shares, which every executor sees as a file system.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators import resolve
from sylva.operators.ordering import mounted, shared_folder
from sylva.operators.scratch import release, scratch
from sylva.plans.catalogue import query
from sylva.plans.fixtures import table
from sylva.sources import directory, directory_stream, tree_sink
from sylva.sources.chunks import Sizes
from sylva.sources.store import Store, read_through
from sylva.streaming.watch import Watch


def _folder(spark: SparkSession, name: str) -> str:
    return mounted(shared_folder(spark, name))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at two depths and an empty directory for each source; ``doc_id``, ``path``, ``type``, ``blob_id``, ``mtime``, ``content``."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    source = F.coalesce("source", F.lit("_"))
    # uneven depths: every fourth file stands beside the languages' directories
    below = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.coalesce("lang", F.lit("_")), F.lit("/")))
    path = F.concat(source, F.lit("/"), below, F.lit("doc-"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", path.alias("path"), F.lit("file").alias("type"), F.sha2(content, 256).alias("blob_id"), ((F.col("doc_id") + 1) * 1000).alias("mtime"), content.alias("content"))
    return files.unionByName(docs.select(F.concat(source, F.lit("/empty")).alias("path"), F.lit("directory").alias("type")).distinct(), allowMissingColumns=True)


def _write(spark: SparkSession, sf_dir: str, name: str) -> str:
    target, entries = _folder(spark, name), _entries(spark, sf_dir)
    directory.make_dirs(entries.where("type = 'directory'").select("path"), target)
    directory.blobs_to_files(entries.where("type = 'file'"), target)
    return target


_SEEN = ("path", "type", "size", "mtime", "blob_id")


def _seen(spark: SparkSession, root: str) -> DataFrame:
    return directory.scan(spark, root, content=False, hashed=True).select(*_SEEN)


@query
def fs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as a directory and scanned."""
    return _seen(spark, _write(spark, sf_dir, "scan"))


@query
def fs_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of that directory, by name alone."""
    return directory.all_files(spark, _write(spark, sf_dir, "listing"))


@query
def fs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned, stored, fetched by the root's hash, written to a second directory, and scanned there."""
    store, target = Store(spark, shared_folder(spark, "store")), _folder(spark, "copy")
    with scratch(spark):  # the first directory goes once it is stored
        ref, _ = store.put_files(_write(spark, sf_dir, "source"), "workTree")
    with scratch(spark):
        store.load(ref, target)
    return _seen(spark, target)


@query
def restore_clean_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory with other files and directories after a restore that cleans it; what was deleted is back."""
    target, entries = _write(spark, sf_dir, "clean"), _entries(spark, sf_dir)
    more = entries.where("type = 'file' and doc_id % 5 = 0").withColumn("path", F.concat(F.lit("stale/"), "path"))
    directory.blobs_to_files(more, target)
    kept = entries.where("doc_id is null or doc_id % 3 != 0")
    directory.restore(spark, kept, entries.where("type = 'file'").select("blob_id", "content").dropDuplicates(["blob_id"]), target, clean=True)
    return directory.scan(spark, target).select("path", "type", "blob_id")


@query
def blobs_to_flat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs written under the names of their sizes, of which the last stays, and read again."""
    target = _folder(spark, "flat")
    rows = _entries(spark, sf_dir).where("type = 'file'")
    name = F.concat(F.lit("len-"), F.floor(F.octet_length("content") / 10).cast("string"))
    directory.blobs_to_files(rows.select(name.alias("path"), F.col("doc_id").alias("place"), "content", "mtime"), target)
    return directory.scan(spark, target).select("path", "blob_id", "mtime")


@query
def store_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two revisions stored one after the other: the files of either that the store gives back by their refs, and the history's length."""
    store, entries = Store(spark, shared_folder(spark, "store")), _entries(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long")).drop("doc_id")
    first, known = store.put(entries, "workTree")
    second, _ = store.put(entries.where("type = 'directory' or mtime % 3000 != 0"), "workTree", [known])
    n = store.versions("workTree").count()
    each = [store.get(ref).where("type = 'file'").select(F.lit(k).alias("version"), "path", "blob_id") for k, ref in enumerate((first, second), 1)]
    stored = each[0].unionByName(each[1]).join(store.blobs.select("blob_id", F.octet_length("content").cast("long").alias("bytes")), "blob_id")
    return stored.select("version", "path", "blob_id", "bytes", F.lit(n).cast("long").alias("n_versions"))


def _disturb(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Changes, adds and deletes files of a written directory."""
    files = _entries(spark, sf_dir).where("type = 'file'")
    directory.blobs_to_files(files.where("doc_id % 7 = 0").withColumn("content", F.concat("content", F.lit("!").cast("binary"))), root)
    directory.blobs_to_files(files.where("doc_id % 11 = 0").withColumn("path", F.concat("path", F.lit("-new"))), root)
    files.where("doc_id % 3 = 1 and doc_id % 7 != 0").select("path").foreachPartition(lambda rows: [os.remove(os.path.join(root, r["path"])) for r in rows if os.path.exists(os.path.join(root, r["path"]))])


@query
def watch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory that is watched while files are added, changed and deleted: the changes of the second step."""
    root = _write(spark, sf_dir, "watched")
    watch = Watch(spark, root, shared_folder(spark, "watch"))
    watch.step()
    _disturb(spark, sf_dir, root)
    step = watch.step()
    stream, rows = watch.changes(), shared_folder(spark, "rows")
    schema = stream.schema
    stream.writeStream.option("checkpointLocation", f"{rows}-state").trigger(availableNow=True).format("parquet").start(rows).awaitTermination()
    return spark.read.schema(schema).parquet(rows).where(F.col("step") == step).select("path", "change")


@query
def stream_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory as a streaming source, read before and after it changes: what the stream says is there in the end.

    The second batch fails once between its snapshot and its changes, and is repeated.
    """
    root, base = _write(spark, sf_dir, "streamed"), shared_folder(spark, "directory")
    failed: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        if number and not failed:
            failed.append(number)
            raise OSError("this batch fails once")

    def run() -> None:
        stream = directory_stream.changes(spark, root, f"{base}/snapshots")
        stream.writeStream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    run()
    _disturb(spark, sf_dir, root)
    try:
        run()
    except Exception as e:
        if "this batch fails once" not in str(e):
            raise
    run()
    told = spark.read.schema(f"{directory_stream.SCHEMA}, batch int").parquet(f"{base}/rows")
    last = told.groupBy("path").agg(F.max_by("change", "batch").alias("change"), F.count("*").alias("n_changes"))
    return last.where("change != 'deleted'").select("path", "n_changes")


@query
def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`store_reads` of a store that is compacted after each revision and once more, with the contents looked up by their ids."""
    store, entries = Store(spark, shared_folder(spark, "store")), _entries(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long")).drop("doc_id")
    first, known = store.put(entries.where("type = 'directory' or mtime % 3000 != 0"), "workTree")
    store.compact(digits=1)
    second, _ = store.put(entries, "workTree", [known])
    store.compact(digits=1)
    store.put(entries.where("type = 'directory'"), "emptyTree")
    n = store.versions("workTree").count()
    each = [store.get(ref).where("type = 'file'").select(F.lit(k).alias("version"), "path", "blob_id") for k, ref in enumerate((second, first), 1)]
    stored = each[0].unionByName(each[1]).join(store.blobs.select("blob_id", F.octet_length("content").cast("long").alias("bytes")), "blob_id")
    return stored.select("version", "path", "blob_id", "bytes", F.lit(n).cast("long").alias("n_versions"))


@query
def chunked_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory stored in content-defined chunks, fetched by the root's hash, written to a second one, and scanned there."""
    store, target = Store(spark, shared_folder(spark, "store")), _folder(spark, "copy")
    with scratch(spark):  # the first directory goes once it is stored
        ref, _ = store.put_directory(_write(spark, sf_dir, "source"), "workTree", sizes=Sizes(64, 256, 1024))
    with scratch(spark):
        store.load(ref, target)
    return _seen(spark, target)


@query
def chunk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each blob the bytes of its chunks, joined in their order and without gaps, as they are stored."""
    store = Store(spark, shared_folder(spark, "store"))
    store.put_directory(_write(spark, sf_dir, "source"), "workTree", sizes=Sizes(64, 256, 1024))
    parts = store.blob_chunks.join(store.chunks, "chunk_id").groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "size", F.hex("content").alias("hex")))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    starts = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok")), lambda a, p: F.struct((a["at"] + p["size"]).alias("at"), (a["ok"] & (a["at"] == p["start"])).alias("ok")))
    return parts.select("blob_id", F.octet_length(whole).cast("long").alias("bytes"), F.sha2(whole, 256).alias("rebuilt"), starts["ok"].alias("whole"))


@query
def transactional_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory after a write that replaces it, one that adds to it, and one that fails: scanned."""
    target, entries = _write(spark, sf_dir, "sink"), _entries(spark, sf_dir)
    blobs = entries.where("type = 'file'").select("blob_id", "content").dropDuplicates(["blob_id"])
    tree_sink.write(entries.where("doc_id is null or doc_id % 2 = 0"), blobs, target, overwrite=True)
    release(spark)
    tree_sink.write(entries.where("doc_id % 3 = 0").withColumn("path", F.concat(F.lit("more/"), "path")), blobs, target)
    release(spark)
    failing = entries.where("type = 'file'").withColumn("path", F.concat(F.lit("never/"), "path"))
    lost = failing.where("doc_id % 5 = 0").select(F.concat("path", F.lit("-lost")).alias("path"), "type", F.lit("none").alias("blob_id"), "mtime")
    try:
        tree_sink.write(failing.select("path", "type", "blob_id", "mtime").unionByName(lost), blobs, target)
    except Exception as e:
        if "no blob for" not in str(e):
            raise
    release(spark)
    return _seen(spark, target)


@query
def write_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that a peer holds, read through a local store and, from that alone, once more."""
    peer, local = Store(spark, shared_folder(spark, "peer")), Store(spark, shared_folder(spark, "local"))
    with scratch(spark):  # the directory goes once the peer holds it
        ref, _ = peer.put_directory(_write(spark, sf_dir, "source"), "workTree", sizes=Sizes(64, 256, 1024))
    with scratch(spark):
        read_through(local, peer, ref)
    unreachable = Store(spark, shared_folder(spark, "no-such-peer"))
    tree = read_through(local, unreachable, ref).where(F.col("path") != paths.ROOT)
    held = local.blob_chunks.join(local.chunks.select("chunk_id"), "chunk_id").groupBy("blob_id").agg(F.sum("size").alias("bytes"))
    return tree.join(held, "blob_id", "left").select("path", "type", F.coalesce("bytes", "size").alias("size"), "mtime", "blob_id")


@query
def failures_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree loaded from a store that lacks some contents: the errors that are recorded beside what is written."""
    entries = _entries(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long")).drop("doc_id")
    store = Store(spark, shared_folder(spark, "store"))
    ref, _ = store.put(entries, "workTree")
    partial = Store(spark, shared_folder(spark, "partial"))
    for name in ("nodes", "edges"):
        getattr(store, name).write.parquet(f"{partial.path}/{name}")
    store.blobs.where(F.octet_length("content") % 6 != 0).write.parquet(f"{partial.path}/blobs")
    target = _folder(spark, "partly")
    partial.load_partly(ref, target)
    done = directory.scan(spark, target).where("type = 'file'").select("path", F.lit("written").alias("outcome"))
    return done.unionByName(partial.errors.select("path", F.col("error").alias("outcome")))


@query
def resolve_three_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fork of three revisions of one tree, which edit and delete files, merged into one: its files."""
    store, entries = Store(spark, shared_folder(spark, "store")), _entries(spark, sf_dir)
    sized = lambda rows: rows.withColumns({"blob_id": F.when(F.col("type") == "file", F.sha2("content", 256)), "size": F.octet_length("content").cast("long")}).drop("doc_id")
    edited = lambda every, by: entries.withColumn("content", F.when(F.col("doc_id") % every == 0, F.concat("content", F.lit(by).cast("binary"))).otherwise(F.col("content")))
    _, base = store.put(sized(entries), "workTree", client_ts=0)
    store.put(sized(edited(2, "!A")), "workTree", [base], "A", 1_000)
    store.put(sized(edited(3, "!B")), "workTree", [base], "B", 2_000)
    store.put(sized(edited(5, "!C").where("type = 'directory' or doc_id % 7 != 3")), "workTree", [base], "C", 3_000)
    found = resolve.resolve_all(store, "workTree")
    return found.result.where(F.col("blob_id") != paths.DIR_MARKER).select("path", "blob_id", "origin", "mtime")


assert paths.DIR_MARKER

_BASE = """base AS (SELECT doc_id, coalesce(source, '_') AS source, coalesce(source, '_') || '/' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(lang, '_') || '/' END || 'doc-' || doc_id AS path,
  sha256(coalesce(text, '')) AS blob_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, (doc_id + 1) * 1000 AS mtime FROM documents)"""
_DIRS = """dirs AS (SELECT DISTINCT d FROM (SELECT unnest([source, source || '/empty']) AS d FROM base UNION ALL SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM {files}))"""
_SCAN = f"WITH {_BASE}, {_DIRS.format(files='base')} SELECT path, 'file' AS type, size, mtime, blob_id FROM base UNION ALL SELECT d, 'directory', NULL, NULL, NULL FROM dirs"

ORACLE_SQL = {
    "fs_scan": _SCAN,
    "fs_roundtrip": _SCAN,
    "fs_listing": f"WITH {_BASE} SELECT path FROM base",
    "restore_clean_target": f"WITH {_BASE}, kept AS (SELECT * FROM base WHERE doc_id % 3 != 0), {_DIRS.format(files='kept')} SELECT path, 'file' AS type, blob_id FROM kept UNION ALL SELECT d, 'directory', NULL FROM dirs",
    "blobs_to_flat_files": f"WITH {_BASE} SELECT 'len-' || (size // 10) AS path, arg_max(blob_id, doc_id) AS blob_id, max(doc_id + 1) * 1000 AS mtime FROM base GROUP BY 1",
    "store_reads": f"WITH {_BASE} SELECT CAST(v AS INTEGER) AS version, path, blob_id, size AS bytes, CAST(2 AS BIGINT) AS n_versions FROM base, (SELECT unnest([1, 2]) AS v) WHERE v = 1 OR mtime % 3000 != 0",
    "chunked_roundtrip": _SCAN,
    "write_through": _SCAN,
    "failures_as_rows": f"WITH {_BASE} SELECT path, CASE WHEN size % 6 = 0 THEN 'no blob ' || blob_id ELSE 'written' END AS outcome FROM base",
    "chunk_lists": f"WITH {_BASE} SELECT DISTINCT blob_id, size AS bytes, blob_id AS rebuilt, true AS whole FROM base",
    "stream_directory": f"""WITH {_BASE}, {_DIRS.format(files='base')} SELECT d AS path, CAST(1 AS BIGINT) AS n_changes FROM dirs UNION ALL SELECT path || '-new', 1 FROM base WHERE doc_id % 11 = 0
  UNION ALL SELECT path, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END FROM base WHERE doc_id % 3 != 1 OR doc_id % 7 = 0""",
    "transactional_sink": f"""WITH {_BASE}, kept AS (SELECT source, path, blob_id, size, mtime FROM base WHERE doc_id % 2 = 0 UNION ALL SELECT 'more/' || source, 'more/' || path, blob_id, size, mtime FROM base WHERE doc_id % 3 = 0),
  up AS (SELECT unnest(['more', 'more/' || source]) AS d FROM base WHERE doc_id % 3 = 0 UNION ALL SELECT unnest([source, source || '/empty']) FROM base UNION ALL SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM kept)
  SELECT path, 'file' AS type, size, mtime, blob_id FROM kept UNION ALL SELECT DISTINCT d, 'directory', NULL, NULL, NULL FROM up""",
    "resolve_three_tips": f"""WITH {_BASE}, t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  v AS (SELECT path, mtime, blob_id AS z, doc_id % 2 = 0 AS has_a, doc_id % 3 = 0 AS has_b, doc_id % 5 = 0 AS has_c, doc_id % 7 = 3 AS gone, sha256(text || '!A') AS a, sha256(text || '!B') AS b, sha256(text || '!C') AS c FROM base JOIN t USING (doc_id))
  SELECT path, CASE WHEN has_c THEN c WHEN has_b THEN b WHEN has_a THEN a ELSE z END AS blob_id, 'merged' AS origin, mtime FROM v WHERE NOT gone
  UNION ALL SELECT path || ' (conflicted copy A 1970-01-01 000001)', a, 'merged', mtime FROM v WHERE has_a AND has_b
  UNION ALL SELECT path || CASE WHEN has_b THEN ' (conflicted copy B 1970-01-01 000002)' ELSE ' (conflicted copy A 1970-01-01 000001)' END, CASE WHEN has_b THEN b ELSE a END, 'copy', mtime FROM v WHERE (has_a OR has_b) AND (has_c OR gone)""",
    "compacted_store": f"WITH {_BASE} SELECT CAST(v AS INTEGER) AS version, path, blob_id, size AS bytes, CAST(2 AS BIGINT) AS n_versions FROM base, (SELECT unnest([1, 2]) AS v) WHERE v = 1 OR mtime % 3000 != 0",
    "watch_changes": f"WITH {_BASE} SELECT path, 'modified' AS change FROM base WHERE doc_id % 7 = 0 UNION ALL SELECT path || '-new', 'added' FROM base WHERE doc_id % 11 = 0 UNION ALL SELECT path, 'deleted' FROM base WHERE doc_id % 3 = 1 AND doc_id % 7 != 0",
}
