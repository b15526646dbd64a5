"""Directories read, stored, restored and kept in step."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sylva.sources import directory
from sylva.sources.store import Store
from sylva.streaming.sync import Agent, Messages, retry


def fill(root, files):
    for path, data in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)


def listing(root):
    return {str(p.relative_to(root)): p.read_bytes() if p.is_file() else None for p in root.rglob("*")}


def scanned(spark, root, **options):
    return {r["path"]: r["type"] for r in directory.scan(spark, root, **options).collect()}


def test_scan(spark, tmp_path):
    fill(tmp_path, {"file1.txt": b"content1", "sub/nested.txt": b"", ".hidden": b"x", "_under": b"y", "node_modules/p.json": b"{}", "distribution/x": b"1", "l1/l2/l3/deep.txt": b"d"})
    (tmp_path / "empty-dir").mkdir()
    os.symlink(tmp_path / "file1.txt", tmp_path / "link")
    found = scanned(spark, tmp_path)
    assert set(found) == {"file1.txt", "sub", "sub/nested.txt", ".hidden", "_under", "l1", "l1/l2", "l1/l2/l3", "l1/l2/l3/deep.txt", "empty-dir"}
    assert "node_modules/p.json" in scanned(spark, tmp_path, ignore=None)
    assert "l1/l2" in scanned(spark, tmp_path, max_depth=2) and "l1/l2/l3" not in scanned(spark, tmp_path, max_depth=2)
    assert scanned(spark, tmp_path, max_depth=0) == {}
    with pytest.raises(Exception, match="not a directory"):
        directory.scan(spark, tmp_path / "file1.txt").collect()


def test_blobs(spark, tmp_path):
    fill(tmp_path, {"b": bytes([0, 1, 255]), "a": b""})
    got = directory.files_to_blobs(spark, [str(tmp_path / "b"), str(tmp_path / "a")], include_path=False).orderBy("place").collect()
    assert [(r["name"], r["size"], r["path"], bytes(r["content"])) for r in got] == [("b", 3, "", b"\x00\x01\xff"), ("a", 0, "", b"")]
    assert directory.files_to_blobs(spark, []).count() == 0


def test_store_and_load(spark, tmp_path):
    source, target = tmp_path / "source", tmp_path / "target"
    fill(source, {"a.txt": b"same", "d/b.txt": b"same", "d/with space-.x.y": bytes(range(256)), "empty.txt": b""})
    (source / "void").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    ref, first = store.put(directory.scan(spark, source), "docsTree")
    again, second = store.put(directory.scan(spark, source), "docsTree", [first])
    assert ref == again and store.nodes.count() == store.nodes.dropDuplicates(["hash"]).count() == 7
    assert store.blobs.count() == 3 and store.has_blob(store.blobs.first()["blob_id"]) and not store.has_blob("none")
    assert [r["time_id"] for r in store.versions("docsTree").collect()] == [first, second]
    fill(target, {"stale/old.txt": b"1", "a.txt": b"other"})
    store.load(ref, str(target), clean=True)
    assert listing(target) == listing(source)
    assert os.stat(target / "a.txt").st_mtime_ns // 1_000_000 == os.stat(source / "a.txt").st_mtime_ns // 1_000_000
    with pytest.raises(ValueError):
        store.put(directory.scan(spark, source), "docs")
    with pytest.raises(LookupError):
        store.blob("none")


def test_restore_errors(spark, tmp_path):
    tree = spark.createDataFrame([("f", "file", "lost", 0)], "path string, type string, blob_id string, mtime long")
    blobs = spark.createDataFrame([], "blob_id string, content binary")
    with pytest.raises(directory.RestoreError):
        directory.write_tree(tree, blobs, str(tmp_path / "t"))
    fill(tmp_path, {"t2/p": b"file"})
    held = spark.createDataFrame([("lost", b"x")], "blob_id string, content binary")
    with pytest.raises(Exception, match="stands at or above"):
        directory.write_tree(tree.withColumn("path", F.lit("p/x")), held, str(tmp_path / "t2"))
    with pytest.raises(Exception, match="leaves the target"):
        directory.write_tree(tree.withColumn("path", F.lit("../x")), held, str(tmp_path / "t3"))


def test_two_clients_and_a_fork(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    fill(one, {"shared.txt": b"base", "d/only.txt": b"1"})
    two.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    sent = []
    box = type("Box", (), {"send": lambda self, m: sent.append(m)})()
    a, b = (Agent(spark, str(r), store, "docsTree", n, box, base_ms=0) for r, n in ((one, "A"), (two, "B")))
    ref = a.push()
    assert a.push() is None and len(sent) == 1
    assert b.take(ref) == "restore" and listing(two) == listing(one)
    assert b.take(ref) == "stop"
    fill(one, {"shared.txt": b"from A"})
    fill(two, {"shared.txt": b"from B"})
    ra = a.push()
    b.push()
    assert sent[-1]["predecessors"] == [ref]
    assert b.take(ra, [ref]) == "merge"
    kept = listing(two)
    assert kept["shared.txt"] in (b"from A", b"from B") and kept["d/only.txt"] == b"1"
    copies = [p for p in kept if "conflicted copy" in p]
    assert len(copies) == 1 and {kept["shared.txt"], kept[copies[0]]} == {b"from A", b"from B"}
    assert len(store.forks("docsTree").collect()) == 1
    a.pause()
    assert a.push() is None and a.missed


def test_recovery_and_retry(spark, tmp_path):
    (tmp_path / "r").mkdir()
    agent = Agent(spark, str(tmp_path / "r"), Store(spark, str(tmp_path / "s")), "xTree", "A", None, retries=1, recoveries=1, base_ms=1000)
    waits = []
    assert agent.take_with_recovery("unknown", sleep=waits.append) is None
    assert waits == [1, 2, 2, 1, 2] and len(agent.errors) == 4
    tries = iter([ValueError, ValueError, None])

    def act():
        e = next(tries)
        if e:
            raise e
        return "done"

    slept = []
    assert retry(act, 3, 100, slept.append) == "done" and slept == [0.1, 0.2]


def test_incoming_stream(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    fill(one, {"a": b"1"})
    two.mkdir()
    store, messages = Store(spark, str(tmp_path / "store")), Messages(spark, str(tmp_path / "refs"))
    Agent(spark, str(one), store, "docsTree", "A", messages).push()
    agent = Agent(spark, str(two), store, "docsTree", "B", messages, base_ms=0)
    agent.incoming(messages.stream(), str(tmp_path / "state"), available_now=True).awaitTermination()
    assert listing(two) == listing(one)


def test_incoming_waits_and_remembers(spark, tmp_path):
    """The newest ref once none has come for a while; what was taken is passed over, what failed is taken again."""
    (tmp_path / "two").mkdir()
    messages = Messages(spark, str(tmp_path / "refs"))
    agent = Agent(spark, str(tmp_path / "two"), Store(spark, str(tmp_path / "store")), "docsTree", "B", messages)
    taken, outcomes = [], iter([None, "restore"])
    agent.take_with_recovery = lambda ref, _: (taken.append(ref), next(outcomes))[1]

    def send(ref, seq, origin="A", tree="docsTree"):
        messages.send({"tree": tree, "origin": origin, "ref": ref, "seq": seq})

    def run(n):
        agent.incoming(messages.stream(), str(tmp_path / "progress"), available_now=True, received=f"{tmp_path}/received").awaitTermination()
        assert len(taken) == n

    send("one", 1)
    run(1)
    send("one", 2)
    run(2)
    send("one", 3)
    send("mine", 4, origin="B")
    send("other", 5, tree="otherTree")
    run(2)
    assert taken == ["one", "one"]
    # by the clock
    outcomes = iter(["restore"])
    send("two", 6)
    send("three", 7)
    query = agent.incoming(messages.stream(), str(tmp_path / "waiting"), quiet="1 second")
    until = time.time() + 60
    while len(taken) < 3 and time.time() < until:
        time.sleep(0.3)
    query.stop()
    assert taken == ["one", "one", "three"]


def test_blob_writers_and_their_options(spark, tmp_path):
    blobs = spark.createDataFrame([("a/x", 1, "k1", bytearray(b"old"), 5_000), ("a/x", 2, "k2", bytearray(b"new"), 9_000), ("y", 1, "k3", bytearray(b""), None)], "path string, place long, blob_id string, content binary, mtime long")
    directory.blobs_to_files(blobs, str(tmp_path / "t"))
    assert (tmp_path / "t/a/x").read_bytes() == b"new" and (tmp_path / "t/a/x").stat().st_mtime == 9
    directory.blobs_to_files(blobs, str(tmp_path / "u"), preserve_mtime=False)
    assert (tmp_path / "u/a/x").stat().st_mtime > 1_000_000 and (tmp_path / "u/y").read_bytes() == b""
    (tmp_path / "v").mkdir()
    with pytest.raises(Exception, match="no directory for"):
        directory.blobs_to_files(blobs, str(tmp_path / "v"), create_dirs=False)
    directory.blob_to_file(blobs, "k2", str(tmp_path / "v"), "flat.bin", create_dirs=False, mtime=7_000)
    assert (tmp_path / "v/flat.bin").read_bytes() == b"new" and (tmp_path / "v/flat.bin").stat().st_mtime == 7
    with pytest.raises(LookupError):
        directory.blob_to_file(blobs, "none", str(tmp_path / "v"), "x")


def test_a_link_in_the_target_leads_nowhere_else(spark, tmp_path):
    (tmp_path / "target").mkdir()
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "target/link").symlink_to(tmp_path / "elsewhere")
    rows = spark.createDataFrame([("link/x", bytearray(b"1"))], "path string, content binary")
    with pytest.raises(Exception, match="leaves the target"):
        directory.blobs_to_files(rows, str(tmp_path / "target"))
    assert not list((tmp_path / "elsewhere").iterdir())


def test_watch_finds_drift(spark, tmp_path):
    from sylva.streaming.watch import Watch

    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    (root / "d/a").write_text("1")
    (root / ".sync-errors.log").write_text("never told")
    watch = Watch(spark, str(root), f"file://{tmp_path}/watch", ignore=("tmp",))
    assert watch.step() == 1
    (root / "d/a").write_text("2")
    (root / "tmp-x").write_text("ignored")
    (root / "b").write_text("3")
    assert watch.step() == 2
    (root / "b").unlink()
    assert watch.step() == 3 == watch.step() - 1
    told = spark.read.schema("step long, ts timestamp, path string, change string").parquet(f"{tmp_path}/watch/changes")
    assert sorted((r["step"], r["path"], r["change"]) for r in told.collect()) == [(1, "d", "added"), (1, "d/a", "added"), (2, "b", "added"), (2, "d/a", "modified"), (3, "b", "deleted")]
