"""Forks of any number of tips become one revision; times of change survive."""

import hashlib

from sylva.operators import resolve
from sylva.sources.store import Store

KINDS = "path string, type string, size long, mtime long, blob_id string, content binary"


def put(store, spark, files, previous, client, ts, mtime=1_000):
    rows = [(p, "file", len(v), mtime, hashlib.sha256(v).hexdigest(), bytearray(v)) for p, v in files.items()]
    return store.put(spark.createDataFrame(rows, KINDS), "docsTree", previous, client, ts)[1]


def content(store, result):
    held = {r["blob_id"]: bytes(r["content"]) for r in store.blobs.collect()}
    return {r["path"]: held[r["blob_id"]] for r in result.where("blob_id != '<dir>'").collect()}


def test_three_tips(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = put(store, spark, {"same": b"0", "x": b"0", "y": b"0", "gone": b"0"}, [], "Z", 0)
    ids = [
        put(store, spark, {"same": b"0", "x": b"A", "y": b"0", "new": b"A"}, [base], "A", 1_000, mtime=1_000),
        put(store, spark, {"same": b"0", "x": b"B", "y": b"B", "gone": b"0"}, [base], "B", 2_000, mtime=2_000),
        put(store, spark, {"same": b"0", "x": b"C", "y": b"0", "gone": b"0"}, [base], "C", 3_000, mtime=3_000),
    ]
    found = resolve.resolve_all(store, "docsTree")
    assert found.tips == tuple(ids)
    assert content(store, found.result) == {
        "same": b"0", "x": b"C", "y": b"B", "new": b"A", "x (conflicted copy A 1970-01-01 000001)": b"A", "x (conflicted copy B 1970-01-01 000002)": b"B",
    }
    times = {r["path"]: r["mtime"] for r in found.result.collect() if r["blob_id"] != "<dir>"}
    assert times == {"same": 3_000, "x": 3_000, "y": 2_000, "new": 1_000, "x (conflicted copy A 1970-01-01 000001)": 1_000, "x (conflicted copy B 1970-01-01 000002)": 2_000}
    time_id = resolve.store_resolution(store, "docsTree", found)
    last = store.history("docsTree").where(f"time_id = '{time_id}'").first()
    assert list(last["previous"]) == ids and resolve.resolve_all(store, "docsTree") is None


def test_crosswise_merges_have_several_bases(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = put(store, spark, {"x": b"0", "y": b"0"}, [], "Z", 0)
    a = put(store, spark, {"x": b"A", "y": b"0"}, [base], "A", 1_000)
    b = put(store, spark, {"x": b"B", "y": b"0"}, [base], "B", 2_000)
    # each side merged the other's revision and kept its own x; y was changed by the first only
    put(store, spark, {"x": b"A", "y": b"1"}, [a, b], "A", 3_000)
    put(store, spark, {"x": b"B", "y": b"0"}, [b, a], "B", 4_000)
    revisions = store.history("docsTree")
    tips = [spark.createDataFrame([("docsTree", t)], "tree string, start string") for t in sorted(r["time_id"] for r in store.forks("docsTree").collect())]
    assert {r["time_id"] for r in resolve.nearest_ancestors(revisions, *tips).collect()} == {a, b}
    found = resolve.resolve_all(store, "docsTree")
    assert content(store, found.result) == {"x": b"B", "x (conflicted copy A 1970-01-01 000003)": b"A", "y": b"1"}


def test_times_of_a_pair(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    base = put(store, spark, {"p": b"0", "q": b"0", "r": b"0"}, [], "Z", 0)
    put(store, spark, {"p": b"A", "q": b"A", "r": b"0"}, [base], "A", 1_000, mtime=5_000)
    put(store, spark, {"p": b"B", "q": b"0", "r": b"0"}, [base], "B", 2_000, mtime=6_000)
    found = resolve.resolve(store, "docsTree")
    times = {r["path"]: r["mtime"] for r in found.result.collect()}
    assert times == {"p": 6_000, "q": 5_000, "r": 6_000, "p (conflicted copy A 1970-01-01 000001)": 5_000}
