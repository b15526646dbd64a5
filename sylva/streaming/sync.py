"""Two-way sync of a directory through a store and a stream of refs.

Outgoing, changes of the directory become revisions and messages; incoming, messages of others become restores or merges.
Both are ``foreachBatch`` steps over Structured Streaming, so a restart goes on from the checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.functions import paths
from sylva.operators import compare, history, resolve
from sylva.sources import directory
from sylva.sources.store import Store
from sylva.streaming import batches, keyed

REFS = "ts timestamp, tree string, origin string, ref string, seq long, predecessors array<string>"
Result = TypeVar("Result")


def retry(act: Callable[[], Result], attempts: int = 3, base_ms: int = 100, sleep: Callable[[float], None] = time.sleep) -> Result:
    """Calls ``act`` until it succeeds; waits ``base_ms``, twice that, and so on; raises the last error."""
    for k in range(attempts):
        try:
            return act()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(base_ms * 2**k / 1000)
    raise ValueError("there must be an attempt")


class Outbox(Protocol):
    def send(self, message: dict) -> None: ...


@dataclass
class Messages:
    """Refs as a folder of Parquet files, which a stream reads."""

    spark: SparkSession
    path: str

    def send(self, message: dict) -> None:
        row = [(datetime.now(UTC), message["tree"], message["origin"], message["ref"], message["seq"], message.get("predecessors"))]
        self.spark.createDataFrame(row, REFS).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(REFS).parquet(self.path)


@dataclass
class Agent:
    """One client's directory, its place in the store, and what it has sent and taken last."""

    spark: SparkSession
    root: str
    store: Store
    tree: str
    client: str
    outbox: Outbox
    ignore: tuple[str, ...] = ()
    conflicts: bool = True
    retries: int = 3
    base_ms: int = 5000
    recoveries: int = 10
    seq: int = 0
    head: str | None = None
    head_id: str | None = None
    sent_key: str | None = None
    errors: list[str] = field(default_factory=list)
    paused: bool = False
    missed: bool = False

    def extract(self) -> DataFrame:
        return directory.scan(self.spark, self.root, (*paths.SYNC_IGNORE, *self.ignore))

    def _key(self, entries: DataFrame) -> str:
        found = compare.content_key(entries.select("path", F.coalesce("blob_id", F.lit(paths.DIR_MARKER)).alias("blob_id"))).first()
        return found["content_key"] if found else ""

    def push(self) -> str | None:
        """Stores and announces the directory unless its content is what was sent last; the ref or None."""
        if self.paused:
            self.missed = True
            return None
        entries = self.extract().checkpoint()
        key = self._key(entries)
        if key == self.sent_key:
            return None
        parents = [self.head_id] if self.conflicts and self.head_id else None
        ref, self.head_id = retry(lambda: self.store.put(entries, self.tree, parents, self.client), 3, 200)
        self.sent_key, before, self.head = key, self.head, ref
        if ref != before:
            self.seq += 1
            message = {"tree": self.tree, "origin": self.client, "ref": ref, "seq": self.seq, "predecessors": [before] if self.conflicts and before else None}
            retry(lambda: self.outbox.send(message), 3, 100)
        return ref

    def take(self, ref: str, predecessors: list[str] | None = None) -> str:
        """What was done with a ref of another client: stop, ignore, merge or restore."""
        tree = self.store.get(ref).where(F.col("path") != paths.ROOT)
        mine = self.extract().select("path", "type", "blob_id")
        a, b = (x.select("path", F.when(F.col("type") == "directory", paths.DIR_MARKER).otherwise(F.col("blob_id")).alias("blob_id")) for x in (mine, tree))
        if compare.tree_diff(a, b).isEmpty():
            return "stop"
        relation = self._relation(ref, predecessors) if self.conflicts and self.head and predecessors else None
        if relation == "ahead":
            return "ignore"
        if relation == "diverged":
            self.merge()
            return "merge"
        directory.restore(self.spark, tree, self.store.blobs, self.root, clean=True)
        self.head = ref
        known = self.store.history(self.tree).where(F.col("ref") == ref).agg(F.max("time_id").alias("t")).first()["t"]
        self.head_id, self.sent_key = known, self._key(self.extract())
        return "restore"

    def _relation(self, ref: str, predecessors: list[str]) -> str:
        """Whether the head is among the ref's ancestors (behind), the ref among the head's (ahead), or neither."""
        revisions = self.store.history(self.tree)
        last = history.latest_predecessors(revisions)
        heads = last.where(F.col("ref").isin(self.head, ref, *predecessors)).select("ref", "time_id").collect()
        ids = {r["ref"]: r["time_id"] for r in heads}
        starts = [(self.tree, ids[x]) for x in {self.head, *predecessors} if x in ids]
        reached = history.reach(revisions, self.spark.createDataFrame(starts, "tree string, start string"))
        ancestors = reached.join(revisions.select("time_id", "ref"), "time_id").where(F.col("start").isin(*(t for _, t in starts)))
        asked = ancestors.where(F.col("ref").isin(self.head, ref)).select("start", "ref").distinct().collect()
        pairs = {(r["start"], r["ref"]) for r in asked}
        if any((ids.get(p), self.head) in pairs for p in predecessors):
            return "behind"
        return "ahead" if (ids.get(self.head), ref) in pairs else "diverged"

    def merge(self) -> str | None:
        """Merges all tips, writes the result to the directory and announces it."""
        found = resolve.resolve_all(self.store, self.tree)
        if found is None:
            return None
        time_id = resolve.store_resolution(self.store, self.tree, found)
        ref = self.store.history(self.tree).where(F.col("time_id") == time_id).first()["ref"]
        directory.restore(self.spark, self.store.get(ref).where(F.col("path") != paths.ROOT), self.store.blobs, self.root, clean=True)
        self.head, self.head_id, self.sent_key = ref, time_id, self._key(self.extract())
        self.seq += 1
        self.outbox.send({"tree": self.tree, "origin": self.client, "ref": ref, "seq": self.seq, "predecessors": None})
        return ref

    def take_with_recovery(self, ref: str, predecessors: list[str] | None = None, sleep: Callable[[float], None] = time.sleep) -> str | None:
        """:meth:`take` with attempts and re-queues; None once given up, after which the ref may be sent anew."""
        for recovery in range(self.recoveries + 1):
            for attempt in range(1, self.retries + 2):
                try:
                    return self.take(ref, predecessors)
                except Exception as e:
                    self.errors.append(f"[{datetime.now(UTC).isoformat(timespec='milliseconds')}] take {ref[:8]}: {e}")
                    sleep(attempt * self.base_ms / 1000)
            if recovery < self.recoveries:
                sleep(self.base_ms * (self.retries + 1) / 1000)
        return None

    def pause(self) -> None:
        self.paused, self.missed = True, False

    def resume(self) -> None:
        self.paused = False
        if self.missed:
            self.missed = False
            self.push()

    def outgoing(self, changes: DataFrame, checkpoint: str, every: str = "30 seconds"):
        """Starts a stream that stores the directory after each batch of changes, and once at its start."""
        self.push()
        return changes.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda batch, _: None if batch.isEmpty() else self.push()).start()

    def incoming(self, refs: DataFrame, checkpoint: str, available_now: bool = False, quiet: str | None = None, received: str | None = None):
        """Starts a stream that takes the newest ref of others in each batch; blank refs are left out.

        With ``quiet`` a ref waits until no newer one has come for so long, by the clock; a newer one takes its place.  With
        ``received``, a folder, refs that were taken are remembered there and passed over when they come again, unless
        taking them failed.
        """
        refs = refs.where((F.col("tree") == self.tree) & (F.col("origin") != self.client) & (F.trim("ref") != ""))
        if quiet is not None:
            refs = keyed.latest_when_quiet(refs, ["tree"], "ts", ["seq"], quiet)
        log = None
        if received is not None:
            schema = T.StructType([*(refs.schema[c] for c in ("origin", "ref", "ts")), T.StructField("invalid", T.BooleanType())])
            log = batches.Log(self.spark, received, ["origin", "ref"], schema)

        def step(batch: DataFrame, number: int) -> None:
            if log is not None:
                batch = batch.join(log.before(number).where("not invalid"), ["origin", "ref"], "left_anti")
            for row in batch.orderBy(F.desc("ts"), F.desc("seq")).limit(1).collect():
                outcome = self.take_with_recovery(row["ref"], row["predecessors"])
                if log is not None:
                    log.write(number, self.spark.createDataFrame([(row["origin"], row["ref"], row["ts"], outcome is None)], log.schema))

        writer = refs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
