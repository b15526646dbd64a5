"""What revisions reach: histories in blocks, each walked in one task, with what crosses blocks sent on in rounds.

Revisions are dealt by ranges of (tree, order) into blocks of a bounded size, so that a block holds many short histories or a
stretch of a long one.  A round walks every block that was entered: along unbranched chains and through merges alike,
each revision of the block once for each start, and sends on what leaves the block, once for each start and revision.
Rows follow the result, whatever the number of merges, and rounds the number of blocks that the longest history passes
through; an order in which predecessors come first (by time) makes that the least, any other is right as well.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.operators.ordering import checkpoint_dir

#: Revisions of a block.
BLOCK_ROWS = 1 << 16
_ROUTE = "array<struct<at:int,place:int>>"
Route = tuple[tuple[int, int], ...]


class Walk:
    """One start's way through a block: ``links`` are ``(place, revision, block or None if it is this one)`` of each revision."""

    def __init__(self, links: dict, seeds: list[tuple[int, Route, object]]):
        self.links, self.seeds = links, sorted(seeds, key=lambda s: s[:2])
        self.hops: dict = {}
        #: The revision and place by which one was met in the block, or the route of a seed.
        self.met: dict = {}
        self.entered: dict = {}
        #: What leaves the block: revision, block, hops and route.
        self.leaving: dict = {}

    def route(self, revision) -> Route:
        """Entries only where the way leaves the first predecessor: its hop, negated, and the place."""
        back = []
        while revision not in self.entered:
            revision, place = self.met[revision]
            if place:
                back.append((-self.hops[revision], place))
        return self.entered[revision] + tuple(reversed(back))

    def run(self) -> Walk:
        """Level by level; a level is in the order of its routes, so the first way that meets a revision is its first one."""
        level, hops, k = [], 0, 0
        while level or k < len(self.seeds):
            if not level:
                hops = self.seeds[k][0]
            while k < len(self.seeds) and self.seeds[k][0] == hops:
                self._enter(level, hops, *self.seeds[k][1:])
                k += 1
            beyond = []
            for revision in level:
                for place, to, block in self.links.get(revision, ()):
                    if block is not None:
                        if to not in self.leaving:
                            self.leaving[to] = (block, hops + 1, self.route(revision) + (((-hops, place),) if place else ()))
                    elif to not in self.hops:
                        self.hops[to], self.met[to] = hops + 1, (revision, place)
                        beyond.append(to)
            level, hops = beyond, hops + 1
        return self

    def _enter(self, level: list, hops: int, route: Route, revision) -> None:
        """Puts a seed where its route belongs, unless the revision is there already on a way that is no later."""
        if revision in self.hops:
            if self.hops[revision] < hops or self.route(revision) <= route:
                return
            level.remove(revision)
        level.insert(bisect_left(level, route, key=self.route), revision)
        self.hops[revision], self.entered[revision] = hops, route


def _walker(schema: T.StructType):
    """Walks the blocks of a stream sorted by (block, tree, kind, start): links (0), revisions whose route is asked for (1), seeds (2)."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        at = start = None
        links: dict = {}
        wanted: dict = {}
        seeds: list = []
        out: list[tuple] = []

        def walked() -> None:
            if seeds:
                walk = Walk(links, seeds).run()
                asked = wanted.get(start, ())
                out.extend((None, at[1], start, v, h, _told(walk.route(v)) if v in asked else None) for v, h in walk.hops.items())
                out.extend((block, at[1], start, v, h, _told(route)) for v, (block, h, route) in walk.leaving.items())
                seeds.clear()

        for batch in batches:
            types = {f.name: f.type for f in batch.schema}
            kinds = [types[n] for n in names]
            for block, tree, kind, own, revision, place, to, to_block, hops, route in zip(*(batch.column(c).to_pylist() for c in ("block", "tree", "kind", "start", "time_id", "place", "to", "to_block", "hops", "route"))):
                if (block, tree) != at:
                    walked()
                    at, links, wanted = (block, tree), {}, {}
                if kind == 0:
                    links.setdefault(revision, []).append((place, to, None if to_block == block else to_block))
                elif kind == 1:
                    wanted.setdefault(own, set()).add(revision)
                else:
                    if own != start:
                        walked()
                    start = own
                    seeds.append((hops, tuple((d["at"], d["place"]) for d in route), revision))
                if len(out) >= 10_000:
                    yield _rows(out, names, kinds)
                    out.clear()
        walked()
        if out:
            yield _rows(out, names, kinds)

    return run


def _told(route: Route) -> list[dict]:
    return [{"at": a, "place": p} for a, p in route]


def _rows(out: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def reach(history: DataFrame, starts: DataFrame, up: bool = True, order: tuple[str, ...] = (), routes_to: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``tree``, ``start``, ``time_id``, ``hops``, ``route``: what each start reaches, itself included, with the fewest hops.

    ``starts`` has ``tree`` and ``start``.  ``up`` follows predecessors, else successors.  Revisions without a row are
    reached, and lead to those that name them as predecessors; a null predecessor is none.  ``order`` names columns of
    ``history`` by which predecessors come before their successors, if its ids don't sort that way.

    ``route`` is that of the first of the shortest ways by the places of predecessors, given for the rows of
    ``routes_to`` (``tree``, ``start``, ``time_id``), else null: an entry for each step that doesn't take the first
    predecessor (``at``: its hop, negated, and ``place``), so that routes sort as the lists of all places would.
    """
    spark = history.sparkSession
    checkpoint_dir(spark)
    named = history.select("tree", "time_id", F.posexplode("previous").alias("place", "parent")).where("parent is not null and tree is not null and time_id is not null")
    key = F.struct(*order, "time_id")
    known = history.where("tree is not null and time_id is not null").groupBy("tree", "time_id").agg(F.min(key).alias("key"))
    unknown = named.select("tree", F.col("parent").alias("time_id")).distinct().join(known, ["tree", "time_id"], "left_anti").withColumn("key", F.lit(None).cast(known.schema["key"].dataType))
    rows = known.unionByName(unknown)
    blocks = max(1, -(-history.count() // block_rows))
    placed = rows.repartitionByRange(blocks, "tree", "key", "time_id").select("tree", "time_id", F.spark_partition_id().alias("block")).checkpoint()
    ends = ("time_id", "parent") if up else ("parent", "time_id")
    links = named.select("tree", F.col(ends[0]).alias("time_id"), F.col(ends[1]).alias("to"), "place").join(placed, ["tree", "time_id"])
    links = links.join(placed.select("tree", F.col("time_id").alias("to"), F.col("block").alias("to_block")), ["tree", "to"])
    # a revision that is named twice is met at its first place
    links = links.groupBy("block", "tree", "time_id", "to", "to_block").agg(F.min("place").cast("int").alias("place")).checkpoint()
    first = starts.select("tree", "start", F.col("start").alias("time_id"), F.lit(0).alias("hops"), F.array().cast(_ROUTE).alias("route")).distinct()
    # a start that no history has reaches itself
    due = first.join(placed, ["tree", "time_id"], "left").checkpoint()
    kinds = {f.name: f.dataType for f in placed.schema} | {f.name: f.dataType for f in due.schema}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in ("block", "tree", "start", "time_id", "hops", "route")])
    found = due.where("block is null").select(*schema.names)
    asked = None if routes_to is None else routes_to.select("tree", "start", "time_id").distinct().join(placed, ["tree", "time_id"]).withColumn("kind", F.lit(1)).checkpoint()
    seen = due = due.where("block is not null")
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while not due.isEmpty():
        # only the links of the blocks that were entered
        entered = due.select("block", "tree").distinct()
        stream = links.join(entered, ["block", "tree"], "left_semi").withColumn("kind", F.lit(0)).unionByName(due.withColumn("kind", F.lit(2)), allowMissingColumns=True)
        if asked is not None:
            stream = stream.unionByName(asked, allowMissingColumns=True)
        order_ = ["block", "tree", "kind", "start", "time_id", "place"]
        walked = stream.repartition(parts, "block", "tree").sortWithinPartitions(*order_).mapInArrow(_walker(schema), schema).checkpoint()
        found = found.unionByName(walked.where("block is null"))
        best = walked.where("block is not null").groupBy("block", "tree", "start", "time_id").agg(F.min(F.struct("hops", "route")).alias("best"))
        before = seen.select("block", "tree", "start", "time_id", F.struct("hops", "route").alias("before"))
        better = best.join(before, ["block", "tree", "start", "time_id"], "left").where(F.col("before").isNull() | (F.col("best") < F.col("before")))
        due = better.select("block", "tree", "start", "time_id", "best.hops", "best.route").checkpoint()
        later = due.select("block", "tree", "start", "time_id")
        seen = seen.select(*due.columns).join(later, later.columns, "left_anti").unionByName(due).checkpoint()
    return found.groupBy("tree", "start", "time_id").agg(F.min(F.struct("hops", "route")).alias("best")).select("tree", "start", "time_id", "best.hops", "best.route")
