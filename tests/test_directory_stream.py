"""A directory as a streaming source: nothing is lost or told twice, whatever fails."""

import os
import time

import pytest

from sylva.sources import directory_stream
from sylva.sources.directory_stream import DirectoryChanges, Snapshots
from sylva.streaming.watch import Watch


def told(rows):
    return sorted((r["path"], r["change"]) for r in rows)


def run(spark, root, state, checkpoint, act):
    stream = directory_stream.changes(spark, root, state)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(act).start().awaitTermination()


def test_a_step_that_fails_loses_nothing(spark, tmp_path):
    root, state, checkpoint = tmp_path / "root", str(tmp_path / "state"), str(tmp_path / "progress")
    root.mkdir()
    (root / "a").write_text("1")
    batches = []
    keep = lambda df, n: batches.append((n, told(df.collect())))
    run(spark, root, state, checkpoint, keep)
    assert batches == [(0, [("a", "added")])]

    (root / "b").write_text("2")
    seen = []

    def broken(df, n):
        seen.append(told(df.collect()))  # the snapshot is written, the changes are not
        raise RuntimeError("no more disk")

    with pytest.raises(Exception, match="no more disk"):
        run(spark, root, state, checkpoint, broken)
    assert seen == [[("b", "added")]]
    # what happens between the failure and the next attempt is told after what the failed step had found
    (root / "b").unlink()
    (root / "c").write_text("3")
    run(spark, root, state, checkpoint, keep)
    run(spark, root, state, checkpoint, keep)
    after = [row for _, rows in batches[1:] for row in rows]
    assert after[0] == ("b", "added") and sorted(after[1:]) == [("b", "deleted"), ("c", "added")]
    assert len(Snapshots(state).numbers()) <= 3


def test_the_state_lies_where_the_address_says(tmp_path, monkeypatch):
    (tmp_path / "elsewhere").mkdir()
    monkeypatch.chdir(tmp_path / "elsewhere")
    for k, address in enumerate((str(tmp_path / "s0"), f"file:{tmp_path}/s1", f"file://{tmp_path}/s2")):
        assert Snapshots(address).new() == 1
        assert (tmp_path / f"s{k}" / "1").is_dir()
    assert os.listdir(tmp_path / "elsewhere") == []
    for address in ("state", "hdfs://host/state"):
        with pytest.raises(ValueError, match="mounted"):
            Snapshots(address)


def test_a_slice_that_was_written_is_not_listed_again(tmp_path):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    for k in range(20):
        (root / "d" / f"f{k}").write_text(str(k))
    options = {"path": str(root), "state": str(tmp_path / "state"), "slices": "4"}
    reader = DirectoryChanges(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    first = [sorted(r[2] for r in reader.read(p)) for p in parts[:2]]
    for k in range(20):
        (root / "d" / f"f{k}").unlink()
    again = DirectoryChanges(options)  # a new reader, as after a restart
    assert [sorted(r[2] for r in again.read(p)) for p in parts[:2]] == first
    assert all(r[2] == "d" for p in parts[2:] for r in again.read(p))
    # the next snapshot finds the rest gone
    later = again.latestOffset()
    rows = [r for p in again.partitions(end, later) for r in again.read(p)]
    assert sorted(r[2] for r in rows if r[3] == "deleted") == sorted(x for part in first for x in part if x != "d")
    again.commit(later)
    assert again.snapshots.numbers() == [later["snapshot"]]
    with pytest.raises(directory_stream.ScanError):
        list(again.read(parts[0].__class__(end["snapshot"], later["snapshot"], 0)))


def test_flat_and_deep_directories_are_dealt_over_slices(tmp_path):
    root = tmp_path / "root"
    for k in range(400):
        path = root / ("flat" if k % 2 else f"deep/d{k % 16}/x/y")
        path.mkdir(parents=True, exist_ok=True)
        (path / f"f{k}").write_text(str(k))
    os.symlink(root / "flat", root / "link")
    (root / "node_modules").mkdir()
    reader = DirectoryChanges({"path": str(root), "state": str(tmp_path / "state"), "slices": "8"})
    parts = [list(r[2] for r in reader.read(p)) for p in reader.partitions({"snapshot": 0}, reader.latestOffset())]
    everything = [x for p in parts for x in p]
    want = {str(p.relative_to(root)) for p in root.rglob("*") if not {"link", "node_modules"} & set(p.relative_to(root).parts)}
    assert len(everything) == len(set(everything)) and set(everything) == want
    assert max(map(len, parts)) < len(everything) / 2 and min(map(len, parts)) > 0


def test_watch_on_a_timer(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a").write_text("1")
    watch = Watch(spark, str(root), f"file://{tmp_path}/watch")
    query = watch.start("1 second")
    try:
        until = time.time() + 60
        while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 1):
            time.sleep(0.5)
        (root / "b").write_text("2")
        (root / "a").unlink()
        while time.time() < until and not {("b", "added"), ("a", "deleted")} <= set(told(watch.latest().collect())):
            time.sleep(0.5)
    finally:
        query.stop()
    assert told(watch.latest().collect()) == [("a", "deleted"), ("b", "added")]
    assert len(watch.written().where("path = 'a'").collect()) == 2


def test_slices_share_the_listing_of_a_large_directory(tmp_path, monkeypatch):
    root = tmp_path / "root"
    for k in range(60):
        path = root / f"d{k % 3}"
        path.mkdir(parents=True, exist_ok=True)
        (path / f"f{k}").write_text(str(k))
    (root / "d0" / "below").mkdir()
    (root / "d0" / "below" / "x").write_text("x")
    monkeypatch.setattr(directory_stream, "FEW", 10, raising=False)
    scandir, listed = os.scandir, []
    monkeypatch.setattr(directory_stream.os, "scandir", lambda d: (listed.append(os.path.relpath(d, root)), scandir(d))[1])
    reader = DirectoryChanges({"path": str(root), "state": str(tmp_path / "state"), "slices": "8"})
    end = reader.latestOffset()
    rows = [r[2] for p in reader.partitions({"snapshot": 0}, end) for r in reader.read(p)]
    assert sorted(rows) == sorted(str(p.relative_to(root)) for p in root.rglob("*"))
    assert [listed.count(d) for d in ("d0", "d1", "d2", "d0/below")] == [1, 1, 1, 1]
    # what is kept of the names goes with the snapshot
    monkeypatch.undo()
    reader.commit(reader.latestOffset())
    assert not (tmp_path / "state" / str(end["snapshot"])).exists()


def test_what_has_become_something_else_since_it_was_listed(tmp_path, monkeypatch):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    for k in range(4):
        (root / f"f{k}").write_text(str(k))
    monkeypatch.setattr(directory_stream, "FEW", 0, raising=False)
    reader = DirectoryChanges({"path": str(root), "state": str(tmp_path / "state"), "slices": "4"})
    end = reader.latestOffset()
    reader.snapshots.names(end["snapshot"], "", 4, 0, reader._dealt(""))  # as another slice has left them
    (root / "f0").unlink()
    (root / "f1").unlink()
    (root / "f1").mkdir()
    (root / "f2").unlink()
    os.symlink(root / "f3", root / "f2")
    (root / "d").rmdir()
    (root / "d").write_text("now a file")
    rows = [r[2] for p in reader.partitions({"snapshot": 0}, end) for r in reader.read(p)]
    assert sorted(rows) == ["d", "f3"]
    later = reader.latestOffset()
    rows = {(r[2], r[3]) for p in reader.partitions(end, later) for r in reader.read(p)}
    assert rows == {("d", "modified"), ("f1", "added")}
