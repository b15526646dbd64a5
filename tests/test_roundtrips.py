"""What the queries that write directories and stores leave on their way."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sylva.operators.ordering import mounted
from sylva.plans import roundtrips
from sylva.sources import directory
from sylva.sources.store import Store

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["chunked_roundtrip", "fs_roundtrip", "write_through"])
def test_the_first_directory_goes_once_it_is_stored(spark, tmp_path, name):
    context = spark.sparkContext
    above = context.getCheckpointDir()
    context.setCheckpointDir(f"file://{tmp_path}")
    try:
        found = getattr(roundtrips, name)(spark, DATA)
        left = os.listdir(mounted(context.getCheckpointDir()))
        assert found.where("type = 'file'").count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    finally:
        context.setCheckpointDir(os.path.dirname(above))
    assert [f for f in left if f.startswith(("source", "scratch"))] == []


def test_put_asks_twice_for_what_is_read_on_demand(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    content = F.concat(F.lit("text "), F.col("id").cast("string")).cast("binary")
    rows = spark.range(20, numPartitions=2).select(F.concat(F.lit("d/f"), F.col("id").cast("string")).alias("path"), F.lit("file").alias("type"), F.lit(6).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.sha2(content, 256).alias("blob_id"), content.alias("content"))
    store = Store(spark, str(tmp_path / "store"))
    store.put(rows.mapInArrow(read, rows.schema), "workTree")
    assert asked.value == 40 and store.blobs.count() == 20


def test_put_files(spark, tmp_path):
    root, target = tmp_path / "root", str(tmp_path / "target")
    (root / "d" / "empty").mkdir(parents=True)
    for k in range(30):
        (root / "d" / f"f{k}").write_bytes(b"same" if k % 3 else b"%d" % k)
    (root / "void").touch()
    store, other = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "other"))
    ref, first = store.put_files(str(root), "workTree")
    assert ref == other.put(directory.scan(spark, str(root)), "workTree")[0]
    held = {r["blob_id"]: bytes(r["content"]) for r in store.blobs.collect()}
    assert held == {hashlib.sha256(c).hexdigest(): c for c in {b"same", b"", *(b"%d" % k for k in range(0, 30, 3))}}
    assert store.put_files(str(root), "workTree", [first])[0] == ref and store.blobs.count() == len(held)
    store.load(ref, target)
    assert {str(p.relative_to(target)): p.read_bytes() if p.is_file() else None for p in (tmp_path / "target").rglob("*")} == {str(p.relative_to(root)): p.read_bytes() if p.is_file() else None for p in root.rglob("*")}
    found = directory.scan(spark, str(root), content=False, hashed=True).where("type = 'file'").checkpoint()
    (root / "void").write_bytes(b"no more")
    with pytest.raises(Exception, match="void has changed since"):
        directory.contents(found, str(root), store.blobs.limit(0)).collect()
