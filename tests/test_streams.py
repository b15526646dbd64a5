"""Streams with state across batches against plain loops."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sylva.streaming import batches
from sylva.streaming.keyed import Bursts, latest_when_quiet

T0 = datetime(2024, 1, 1)
EVENTS = "client long, ts timestamp, event_id long, kind string, invalid boolean"


def events(rng, n):
    """Half of all rows are of one client; nulls among clients and kinds."""
    return [(rng.choice([7, 7, 7, 1, 2, None]), T0 + timedelta(seconds=k // 2), k, rng.choice(["a", "b", None]), rng.random() < 0.2) for k in range(n)]


def written_in(spark, path, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("merge_every", [20, 2])
def test_repeats_across_batches(spark, tmp_path, monkeypatch, merge_every):
    monkeypatch.setattr(batches, "MERGE_EVERY", merge_every)
    rows = events(random.Random(1), 120)
    written_in(spark, str(tmp_path / "in"), [rows[k : k + 30] for k in range(0, 120, 30)])
    source = stream(spark, str(tmp_path / "in"))
    folder = f"file://{tmp_path}/out"
    batches.without_repeats(source, folder, ["client"], ["ts", "event_id"], "kind").trigger(availableNow=True).start().awaitTermination()
    last, want = {}, []
    for r in rows:
        if r[0] not in last or last[r[0]] != r[3]:
            want.append(r[2])
        last[r[0]] = r[3]
    assert sorted(r["event_id"] for r in batches.written(spark, folder, source.schema).collect()) == want


def test_a_repeated_batch_gives_its_rows_once(spark, tmp_path):
    rows = events(random.Random(2), 60)
    written_in(spark, str(tmp_path / "in"), [rows[:30], rows[30:]])
    source, folder = stream(spark, str(tmp_path / "in")), f"file://{tmp_path}/out"
    log = batches.Log(spark, f"{folder}/log", ["client"], batches._types(source, ["client", "kind"]))
    log.write(1, spark.createDataFrame([(7, "wrong"), (1, "wrong")], "client long, kind string"))  # of an attempt that failed before its rows were written
    batches.without_repeats(source, folder, ["client"], ["ts", "event_id"], "kind").trigger(availableNow=True).start().awaitTermination()
    last, want = {}, []
    for r in rows:
        if r[0] not in last or last[r[0]] != r[3]:
            want.append(r[2])
        last[r[0]] = r[3]
    assert sorted(r["event_id"] for r in batches.written(spark, folder, source.schema).collect()) == want


@pytest.mark.parametrize("ttl", [None, 5])
def test_received_refs_pass_again_once_invalid(spark, tmp_path, ttl):
    rows = [(c, T0 + timedelta(seconds=k), k, kind or "n", invalid) for k, (c, _, _, kind, invalid) in enumerate(events(random.Random(3), 120))]
    written_in(spark, str(tmp_path / "in"), [rows[k : k + 40] for k in range(0, 120, 40)])
    source, folder = stream(spark, str(tmp_path / "in")), f"file://{tmp_path}/out"
    batches.not_received_before(source, folder, ["client", "kind"], ttl=None if ttl is None else f"{ttl} seconds").trigger(availableNow=True).start().awaitTermination()
    known, want = {}, []
    for c, ts, k, kind, invalid in rows:
        held = known.get((c, kind))
        if not invalid and (held is None or (ttl is not None and ts - held >= timedelta(seconds=ttl))):
            want.append(k)
        known[c, kind] = None if invalid else ts
    assert sorted(r["event_id"] for r in batches.written(spark, folder, source.drop("invalid").schema).collect()) == want


def test_classified_across_batches(spark, tmp_path):
    rows = events(random.Random(5), 90)
    written_in(spark, str(tmp_path / "in"), [rows[k : k + 30] for k in range(0, 90, 30)])
    source = stream(spark, str(tmp_path / "in")).select(F.coalesce(F.col("client").cast("string"), F.lit("x")).alias("path"), "ts", "event_id", (F.col("kind") == "a").alias("present"))
    folder = f"file://{tmp_path}/out"
    batches.classify(source, folder).trigger(availableNow=True).start().awaitTermination()
    known, want = {}, []
    for client, ts, _, kind, _ in rows:
        path = "x" if client is None else str(client)
        if kind == "a" or known.get(path):
            want.append((path, ts, ("modified" if known.get(path) else "added") if kind == "a" else "deleted"))
        known[path] = kind == "a"
    got = [(r["path"], r["ts"], r["change"]) for r in spark.read.schema("path string, ts timestamp, change string").parquet(f"{folder}/rows").collect()]
    assert sorted(got) == sorted(want)


def test_bursts_in_any_order():
    rng = random.Random(4)
    for _ in range(50):
        times = [rng.randrange(0, 400) for _ in range(40)]
        bursts = Bursts(10)
        for t in times:
            bursts.add(t, ((t,), t))
        want, ordered = [], sorted(times)
        for t in ordered:
            if want and t - want[-1][1] < 10:
                want[-1][1] = t
            else:
                want.append([t, t])
        assert [[a, b] for a, b, _ in bursts.open] == want and all(row[1] == b for _, b, row in bursts.open)
        done = bursts.quiet(200)
        assert all(b + 10 <= 200 for _, b, _ in done) and all(b + 10 > 200 for _, b, _ in bursts.open)


def test_latest_row_by_event_time(spark, tmp_path):
    many = [(3, T0 + timedelta(minutes=k), 100 + k, "m", None) for k in range(20)]
    rows = [*many, (1, T0, 1, "a", None), (1, T0 + timedelta(seconds=20), 3, "c", None), (1, T0 + timedelta(seconds=20), 2, "b", None), (2, T0 + timedelta(seconds=5), 4, None, None), (1, T0 + timedelta(seconds=100), 5, "e", None)]
    written_in(spark, str(tmp_path / "in"), [rows, [(9, T0 + timedelta(hours=1), 6, "end", None)]])
    found = latest_when_quiet(stream(spark, str(tmp_path / "in")), ["client"], "ts", ["event_id"], "30 seconds", "1 second")
    found.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    assert sorted((r["client"], r["event_id"], r["kind"]) for r in got.collect()) == [(1, 3, "c"), (1, 5, "e"), (2, 4, None), *((3, 100 + k, "m") for k in range(20))]


def test_latest_row_by_the_clock(spark, tmp_path):
    written_in(spark, str(tmp_path / "in"), [[(1, T0, k, "x", None)] for k in range(3)])
    found = latest_when_quiet(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), ["client"], "ts", ["event_id"], "2 seconds")
    query = found.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").format("parquet").start(str(tmp_path / "out"))
    try:
        until = time.time() + 60
        got = []
        while time.time() < until and not got:
            time.sleep(0.5)
            got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out/_spark_metadata").exists() else []
    finally:
        query.stop()
    assert [(r["client"], r["event_id"]) for r in got] == [(1, 2)]
    assert F is not None
