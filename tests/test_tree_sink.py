"""A directory as a sink: whole jobs or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from sylva.sources import directory, tree_sink

TREE = "path string, type string, blob_id string, mtime long"


def listing(root):
    return {str(p.relative_to(root)): p.read_bytes() if p.is_file() else None for p in root.rglob("*")}


def tree(spark, rows):
    return spark.createDataFrame(rows, TREE)


def blobs(spark, **held):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in held.items()], "blob_id string, content binary")


ROWS = [("d", "directory", None, None), ("d/e", "directory", None, None), ("d/a", "file", "k1", 5_000), ("b", "file", "k2", None), ("x", "socket", None, None), ("nothing", "file", None, 1)]


def test_append_keeps_what_is_there(spark, tmp_path):
    target = tmp_path / "t"
    (target / "d").mkdir(parents=True)
    (target / "d/a").write_bytes(b"old")
    (target / "other").write_bytes(b"stays")
    tree_sink.write(tree(spark, ROWS), blobs(spark, k1=b"new", k2=b""), str(target))
    assert listing(target) == {"d": None, "d/e": None, "d/a": b"new", "b": b"", "other": b"stays"}
    assert (target / "d/a").stat().st_mtime == 5


def test_overwrite_takes_the_targets_place(spark, tmp_path):
    target = tmp_path / "t"
    (target / "old/deep").mkdir(parents=True)
    (target / "old/deep/x").write_bytes(b"1")
    tree_sink.write(tree(spark, ROWS), blobs(spark, k1=b"new", k2=b"2"), str(target), overwrite=True)
    assert listing(target) == {"d": None, "d/e": None, "d/a": b"new", "b": b"2"}
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_failed_job_leaves_the_target_as_it_was(spark, tmp_path, overwrite):
    target = tmp_path / "t"
    target.mkdir()
    (target / "f0").write_bytes(b"old")
    before = listing(target)
    many = [(f"f{k}", "file", "k1", None) for k in range(50)]
    with pytest.raises(Exception, match="no blob for lost"):
        tree_sink.write(tree(spark, [*many, ("lost", "file", "gone", None)]).repartition(4), blobs(spark, k1=b"new"), str(target), overwrite)
    with pytest.raises(Exception, match="leaves the target"):
        tree_sink.write(tree(spark, [*many, ("../out", "file", "k1", None)]).repartition(4), blobs(spark, k1=b"new"), str(target), overwrite)
    assert listing(target) == before and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="no blob for lost"):
        tree_sink.write(tree(spark, [("lost", "file", "gone", None)]), blobs(spark, k1=b"new"), str(tmp_path / "new"), overwrite)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_commit_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    target = tmp_path / "t"
    target.mkdir()
    writer = tree_sink.TreeWriter({"path": str(target)}, False)
    row = lambda path, data: {"path": path, "type": "file", "mtime": None, "content": data}
    sent = [writer.write(iter([row("a", b"1"), row("d/b", b"2")])), writer.write(iter([row("c", b"3")]))]
    writer.write(iter([row("never", b"4")]))  # an attempt that wasn't committed
    moved = []

    def breaks(source, full, replace=os.replace):
        if full.endswith("/c"):
            raise OSError("lost")
        moved.append(full)
        replace(source, full)

    monkeypatch.setattr(tree_sink.os, "replace", breaks)
    with pytest.raises(OSError):
        writer.commit(sent)
    monkeypatch.undo()
    writer.abort(sent)  # a decided job is not taken back
    assert tree_sink.recover(str(target)) == 1 and tree_sink.recover(str(target)) == 0
    assert listing(target) == {"a": b"1", "d": None, "d/b": b"2", "c": b"3"}


def test_an_overwrite_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    target = tmp_path / "t"
    target.mkdir()
    (target / "old").write_bytes(b"0")
    writer = tree_sink.TreeWriter({"path": str(target)}, True)
    sent = [writer.write(iter([{"path": "a", "type": "file", "mtime": None, "content": b"1"}]))]
    renamed = []

    def breaks(source, full, rename=os.rename):
        if renamed and full == str(target):
            raise OSError("lost")
        rename(source, full)
        renamed.append(full)

    monkeypatch.setattr(tree_sink.os, "rename", breaks)
    with pytest.raises(OSError):
        writer.commit(sent)
    monkeypatch.undo()
    assert not target.exists() and tree_sink.recover(str(target)) == 1
    assert listing(target) == {"a": b"1"} and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_odd_targets(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "t/link").symlink_to(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="leaves the target"):
        tree_sink.write(tree(spark, [("link/x", "file", "k", None)]), blobs(spark, k=b"1"), str(tmp_path / "t"))
    assert not list((tmp_path / "elsewhere").iterdir())
    with pytest.raises(Exception, match="a directory stands at p"):
        tree_sink.write(tree(spark, [("p/x", "file", "k", None), ("p", "file", "k", None)]), blobs(spark, k=b"1"), str(tmp_path / "t"))
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["link"]
    (tmp_path / "u").mkdir()
    (tmp_path / "u/p").write_bytes(b"file")
    with pytest.raises(Exception, match="stands at or above"):
        tree_sink.write(tree(spark, [("p/x", "file", "k", None)]), blobs(spark, k=b"1"), str(tmp_path / "u"))
    tree_sink.write(tree(spark, []), blobs(spark, k=b"1"), str(tmp_path / "new"), overwrite=True)
    assert listing(tmp_path / "new") == {}


def test_round_trip(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    (source / "a/b").mkdir(parents=True)
    (source / "void").mkdir()
    for k in range(20):
        (source / ("a/b" if k % 2 else "a") / f"f{k}").write_bytes(bytes([k]) * k)
    found = directory.scan(spark, str(source))
    tree_sink.write(found, found.where(F.col("type") == "file").select("blob_id", "content").dropDuplicates(["blob_id"]), str(target))
    assert listing(target) == listing(source)


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_commit_holds_few_rows_of_the_lists(tmp_path, monkeypatch, overwrite):
    target, n = tmp_path / "t", 2_000
    target.mkdir()
    monkeypatch.setattr(tree_sink, "MOVES", 4)
    monkeypatch.setattr(tree_sink, "MOVE_ROWS", 10, raising=False)
    monkeypatch.setattr(tree_sink, "KNOWN", 7, raising=False)
    writer = tree_sink.TreeWriter({"path": str(target)}, overwrite)
    message = writer.write(iter([{"path": f"d{k % 20}/e/f{k}", "type": "file", "mtime": None, "content": b"%d" % k} for k in range(n)]))
    told, moved, ahead = tree_sink._entries, [], []

    def entries(*of):
        for k, entry in enumerate(told(*of)):
            if moved:
                ahead.append(k - len(moved))
            yield entry

    replace = os.replace
    monkeypatch.setattr(tree_sink, "_entries", entries)
    monkeypatch.setattr(tree_sink.os, "replace", lambda a, b: (moved.append(b), replace(a, b)))
    writer.commit([message])
    assert listing(target) == {**{f"d{k}": None for k in range(20)}, **{f"d{k}/e": None for k in range(20)}, **{f"d{k % 20}/e/f{k}": b"%d" % k for k in range(n)}}
    assert max(ahead) <= 100


def test_an_attempt_that_fails_leaves_no_files(tmp_path):
    (tmp_path / "t").mkdir()
    writer = tree_sink.TreeWriter({"path": str(tmp_path / "t")}, False)
    with pytest.raises(Exception, match="leaves the target"):
        writer.write(iter([{"path": p, "type": "file", "mtime": None, "content": b"1"} for p in ("a", "b", "../c")]))
    assert [p for p in (tmp_path / "t").rglob("*") if p.is_file() and p.suffix != ".part"] == []
