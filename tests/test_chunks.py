"""Files in content-defined chunks, and listings dealt over tasks."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.sources import chunks, directory
from sylva.sources.chunks import Chunker, Sizes
from sylva.sources.store import Store

SMALL = Sizes(64, 256, 1024)


def cut_all(data, sizes, piece):
    chunker, out = Chunker(sizes), []
    for at in range(0, len(data), piece):
        out += chunker.feed(data[at : at + piece])
    return out + list(chunker.feed(b"", last=True))


def brute_cut(data, sizes):
    """Byte by byte: the hash of the last 32 bytes has zeros in its highest places."""
    bits, out, start = (sizes.usual - 1).bit_length(), [], 0
    for end in range(1, len(data) + 1):
        n = end - start
        if n < sizes.least:
            continue
        h = sum(int(chunks._VALUES[b]) << k for k, b in enumerate(reversed(data[max(0, end - 32) : end]))) % (1 << 32)
        if n == sizes.most or h >> (32 - bits) == 0:
            out.append(data[start:end])
            start = end
    return out + ([data[start:]] if start < len(data) else [])


def test_chunks_match_brute_force_however_a_file_is_read():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 5_000, 20_000):
        data = rng.randbytes(n)
        want = brute_cut(data, SMALL)
        for piece in (1_000_000, 4_097, 100):
            assert cut_all(data, SMALL, piece) == want
        assert b"".join(want) == data and all(64 <= len(c) <= 1024 for c in want[:-1])
    assert [len(c) for c in cut_all(b"\0" * 5_000, SMALL, 999)][:-1] == [len(brute_cut(b"\0" * 5_000, SMALL)[0])] * (len(brute_cut(b"\0" * 5_000, SMALL)) - 1)


def test_an_insertion_moves_few_borders():
    data = np.random.default_rng(5).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    changed = data[:90_000] + b"inserted" + data[90_000:]
    a, b = (set(cut_all(x, SMALL, 1 << 16)) for x in (data, changed))
    assert len(b - a) <= 3 and 100 < len(a)
    with pytest.raises(ValueError):
        Sizes(8, 16, 32)


def test_files_cut_together_have_the_chunks_of_each_by_itself(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    files = [rng.randbytes(n) for n in (0, 1, 64, 5_000, 0, 20_000, 31, 1_024)] + [b"\0" * 3_000, b""]
    assert list(chunks.cut_together(files, SMALL)) == [brute_cut(f, SMALL) for f in files]
    # in batches of many files and chunks, a file of any size among them
    monkeypatch.setattr(chunks, "TOGETHER", 10_000)
    for k, f in enumerate(files):
        (tmp_path / f"f{k}").write_bytes(f)
    batches = list(chunks._described(str(tmp_path), SMALL)(iter([pa.RecordBatch.from_pydict({"path": [*(f"f{k}" for k in range(len(files))), "gone"]})])))
    rows = {r["path"]: r for b in batches for r in b.to_pylist()}
    assert len(rows) == len(files) and len(batches) < 5
    for k, f in enumerate(files):
        of = rows[f"f{k}"]
        assert (of["size"], of["blob_id"]) == (len(f), hashlib.sha256(f).hexdigest())
        assert [f[c["start"] : c["start"] + c["size"]] for c in of["chunks"]] == (brute_cut(f, SMALL) or [b""])
        assert [c["chunk_id"] for c in of["chunks"]] == [hashlib.sha256(f[c["start"] : c["start"] + c["size"]]).hexdigest() for c in of["chunks"]]


def test_small_contents_travel_in_batches_of_many():
    kinds = {"id": pa.string(), "content": pa.binary()}
    batches = list(directory.in_batches(((str(k), b"x" * 300) for k in range(5_000)), kinds, 1))
    assert len(batches) <= 10 and [r["id"] for b in batches for r in b.to_pylist()] == [str(k) for k in range(5_000)]
    large = list(directory.in_batches(((str(k), b"x" * directory.BYTES_AT_ONCE) for k in range(3)), kinds, 1))
    assert [b.num_rows for b in large] == [1, 1, 1]


def test_a_large_file_is_stored_once_and_restored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(directory, "LARGEST_FILE", 10_000)
    source, target = tmp_path / "source", tmp_path / "target"
    (source / "d").mkdir(parents=True)
    (source / "void").mkdir()
    data = np.random.default_rng(6).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    (source / "d/large").write_bytes(data)
    (source / "copy").write_bytes(data)
    (source / "longer").write_bytes(data[:150_000] + b"more" + data[150_000:])
    (source / "empty").write_bytes(b"")
    os.utime(source / "copy", (5, 5))
    store = Store(spark, str(tmp_path / "store"))
    ref, first = store.put_directory(str(source), "docsTree", sizes=Sizes(512, 2048, 8192))
    held = store.chunks.agg(F.sum(F.octet_length("content"))).first()[0]
    assert 300_000 < held < 330_000
    again, _ = store.put_directory(str(source), "docsTree", [first], sizes=Sizes(512, 2048, 8192))
    assert again == ref and store.chunks.count() == store.chunks.select("chunk_id").distinct().count()
    assert store.blob(hashlib.sha256(data).hexdigest()) == data and store.blob(hashlib.sha256(b"").hexdigest()) == b""
    (target / "stale").mkdir(parents=True)
    (target / "stale/x").write_bytes(b"1")
    store.load(ref, str(target), clean=True)
    got = {str(p.relative_to(target)): p.read_bytes() if p.is_file() else None for p in target.rglob("*")}
    assert got == {str(p.relative_to(source)): p.read_bytes() if p.is_file() else None for p in source.rglob("*")}
    assert (target / "copy").stat().st_mtime == 5
    with pytest.raises(Exception, match="read it in chunks"):
        directory.scan(spark, source).collect()


def test_a_missing_chunk_leaves_the_target_as_it_was(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    source.mkdir()
    target.mkdir()
    (source / "f").write_bytes(bytes(range(256)) * 40)
    (target / "f").write_bytes(b"old")
    _, files = chunks.describe(spark, str(source), sizes=SMALL)
    stored = chunks.contents(files, str(source), spark.createDataFrame([], "chunk_id string")).checkpoint()
    tree = files.select("path", "blob_id", "mtime")
    lost = stored.orderBy("chunk_id").limit(1)
    with pytest.raises(Exception, match="no chunk of f"):
        chunks.write(tree, chunks.blob_chunks(files), stored.join(lost, "chunk_id", "left_anti"), str(target))
    assert {p.name: p.read_bytes() for p in target.iterdir()} == {"f": b"old"}
    chunks.write(tree, chunks.blob_chunks(files), stored, str(target))
    assert {p.name: p.read_bytes() for p in target.iterdir()} == {"f": bytes(range(256)) * 40}
    (source / "f").write_bytes(b"changed")
    with pytest.raises(Exception, match="has changed since"):
        chunks.contents(files, str(source), spark.createDataFrame([], "chunk_id string")).collect()


def test_flat_and_deep_directories_use_many_tasks(spark, tmp_path):
    (tmp_path / "flat").mkdir()
    for k in range(3_000):
        (tmp_path / "flat" / f"f{k}").touch()
    for k in range(200):
        (tmp_path / f"deep/a/b/d{k}").mkdir(parents=True)
        (tmp_path / f"deep/a/b/d{k}/x").touch()
    found = directory.scan(spark, tmp_path, content=False).withColumn("task", F.spark_partition_id())
    files = found.where("type = 'file'").groupBy("task").count().collect()
    assert len(files) >= 8 and max(r["count"] for r in files) < 1_000 and sum(r["count"] for r in files) == 3_200
    listed = directory.dealt(directory.listing(spark, tmp_path).where("path like 'deep/a/b/d%' and type = 'directory'").select("path"), 200, directory.TASK_DIRS)
    assert listed.select(F.spark_partition_id()).distinct().count() >= 3


def opened_files(found):
    """Files that the scans of a DataFrame read when it is run."""
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    scans, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            scans.append(node.metrics().apply("numFiles").value())
        waiting += [node.children().apply(k) for k in range(node.children().size())]
    return sum(scans)


def test_a_compacted_store_opens_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    kinds = "path string, type string, size long, mtime long, blob_id string, content binary"
    held = {}
    for k in range(3):
        data = {f"f{n}": f"content {k % 2} {n}".encode() for n in range(40)}
        held |= {hashlib.sha256(v).hexdigest(): v for v in data.values()}
        rows = [(p, "file", len(v), 1, hashlib.sha256(v).hexdigest(), bytearray(v)) for p, v in data.items()]
        ref, _ = store.put(spark.createDataFrame(rows, kinds).repartition(4), "docsTree")
        if k == 1:
            store.compact(digits=1)
    # a row that is stored twice, as by two writers at once
    store.blobs.limit(1).write.mode("append").parquet(f"{store.path}/blobs")
    before = opened_files(store._table("blobs", "blob_id string, content binary"))
    store.compact(digits=1)
    store.compact("blobs", digits=1)
    some = sorted(held)[::9]
    assert [store.blob(b) for b in some] == [held[b] for b in some] and not store.has_blob("f" * 64)
    assert store.blobs.count() == store.blobs.select("blob_id").distinct().count() == len(held)
    assert store.holds(ref) and {r["path"] for r in store.get(ref).collect()} == {".", *(f"f{n}" for n in range(40))}
    opened = opened_files(store._table("blobs", "blob_id string, content binary", some[0]))
    assert opened <= 2 < before
    # what is appended later is found beside the generation
    more = bytearray(b"appended")
    store.put(spark.createDataFrame([("g", "file", 8, 1, hashlib.sha256(more).hexdigest(), more)], kinds), "docsTree")
    assert store.blob(hashlib.sha256(more).hexdigest()) == b"appended" and store.blobs.count() == len(held) + 1
