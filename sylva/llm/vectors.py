"""What the searches over vectors share: integer vectors, classes of equal rows, shards, blocks of queries, waves.

Rows of one vector (and label) are one class, which keeps the smallest ids that a result can hold, so that a vector
that a third of all rows have is scored once.  Classes are dealt by a tree of half spaces, fitted on a bounded sample,
into shards of near vectors; the queries' classes likewise into blocks.  A bound for each block and shard orders the
shards of a block.  They are searched in waves, the best shard first, then seven, then the rest: after each wave the
least score that still counts, found by then in any shard, is sent along with the block, and shards whose bound is
lower aren't asked.

An ask is a query's wish for its ``keep`` best rows with a score from ``lo`` to ``hi``.  Bounds may be loose, never
wrong; scores are integers and exact.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part; an empty vector has score 0;
the shorter of two vectors counts as zero beyond its end; null ids come last among equal scores; rows that repeat are
each found; a score beyond 63 bits is an error.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.tables import checkpoint_dir, scratch_path

#: Rows of a shard and of a block of queries; blocks that meet a shard in one task; bounds that are found at once.
SHARD_ROWS, BLOCK_ROWS, GROUP_BLOCKS, PACK_SHARDS = 4_096, 256, 64, 1_024
#: Rows to which the half spaces are fitted, and how often they are halved.
SAMPLE_ROWS, HALVINGS = 4_096, 8
#: Last shard of each wave, in the order of a block's bounds.
WAVES = (1, 8, None)
LEAST, MOST = -(1 << 62), 1 << 62


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def integers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def digest(vector: Column, label: Column) -> Column:
    """The name of the class of an integer vector and a label."""
    return F.unhex(F.sha2(F.concat_ws(",", label.cast("string"), F.transform(vector, lambda x: x.cast("string"))), 256))


def named(rows: DataFrame, id_: Column, vector: Column, label: Column, scale: int = 256) -> DataFrame:
    """``id``, ``label``, ``vector`` (integers) and ``key`` of the rows that take part."""
    found = rows.where(usable(vector) & label.isNotNull()).select(id_.cast("long").alias("id"), label.cast("long").alias("label"), integers(vector, scale).alias("vector"))
    return found.withColumn("key", digest(F.col("vector"), F.col("label")))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """``key``, ``label``, ``vector``, ``ids``: the ``keep`` smallest ids of each class, null last.

    Spark keeps that many of each key before it shuffles.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("id")))
    kept = rows.withColumn("place", place).where(F.col("place") <= keep)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda s: s["id"])
    return kept.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), ids.alias("ids"))


def to_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_bytes(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists as the rows of an int64 matrix, filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def products(rows: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; ``largest`` is more than any sum of their terms' sizes can be."""
    if largest < 1 << 53:  # whole numbers of this size are exact in doubles
        return (rows.astype(np.float64, copy=False) @ query.astype(np.float64)).astype(np.int64)
    if largest < 1 << 63:
        return rows.astype(np.int64) @ query.astype(np.int64)
    raise OverflowError("scores of these vectors don't fit 64 bits")


def half_spaces(sample: np.ndarray, halvings: int = HALVINGS) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of a complete binary tree, each halving what is left of the sample along its widest span."""
    nodes = (1 << halvings) - 1
    directions, thresholds, held = np.zeros((nodes, sample.shape[1])), np.zeros(nodes), {0: sample.astype(np.float64)}
    for node in range(nodes):
        own = held.pop(node)
        if len(own) > 1:
            directions[node] = widest(own)
            at = own @ directions[node]
            thresholds[node] = np.median(at)
            upper = at > thresholds[node]
        else:
            upper = np.zeros(len(own), bool)
        if 2 * node + 2 < nodes:
            held[2 * node + 1], held[2 * node + 2] = own[~upper], own[upper]
    return directions, thresholds


def widest(rows: np.ndarray) -> np.ndarray:
    """From the row that is farthest from the mean to the one that is farthest from it."""
    one = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
    return rows[np.argmax(((rows - one) ** 2).sum(axis=1))] - one


def cells(rows: np.ndarray, directions: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    width = max(rows.shape[1], directions.shape[1])
    x, along = widened(rows.astype(np.float64), width), widened(directions, width)
    node = np.zeros(len(x), np.int64)
    while len(directions) and len(x) and node[0] < len(directions):
        node = 2 * node + 1 + ((x * along[node]).sum(axis=1) > thresholds[node])
    return node - len(directions)


class Searcher(Protocol):
    """How a search bounds the scores of a shard's rows."""

    def shard(self, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """An order of the rows, and arrays of the shard in that order; those named ``sum_...`` are sent to :meth:`bounds`."""

    def bounds(self, queries: dict[str, np.ndarray], shards: list[dict[str, np.ndarray]]) -> np.ndarray:
        """No score of a query (row) and a row of a shard (column) is greater; -inf where none is asked for."""

    def query(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """What bounds need of the queries of a block."""

    def visit(self, shard: dict[str, np.ndarray], queries: dict[str, np.ndarray], q: int, window: list[int]) -> Iterator[np.ndarray]:
        """Places of rows to be scored for query ``q``, the most promising first, until no other's score can lie in ``window``,
        which shrinks meanwhile."""


def spaces(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Half spaces of a bounded sample of classes, drawn by their names; of few classes there are few."""
    rows = found.orderBy("key").limit(SAMPLE_ROWS).select("vector").collect()
    halvings = max(0, min(HALVINGS, len(rows).bit_length() - 5))
    return half_spaces(matrix(pa.array([r["vector"] for r in rows], pa.list_(pa.int64()))), halvings)


def _celled(rows: DataFrame, tree: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells(matrix(batch.column("vector")), *tree))], names=[*batch.schema.names, "cell"])

    rows = rows.select("key", "label", "vector", "ids")
    return rows.mapInArrow(run, "key binary, label long, vector array<long>, ids array<long>, cell long")


def packed(rows: DataFrame, size: int, searcher: Searcher, tree: tuple[np.ndarray, np.ndarray], query: bool, path: str) -> DataFrame:
    """Rows of near vectors and labels in packs of at most ``size``, written: ``pack`` (its first key), ``low``, ``high`` (labels), ``summary``, ``body``."""
    total = rows.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield _pack(table.slice(0, size), searcher, query)
                held = table.slice(size).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield _pack(pa.Table.from_batches(held), searcher, query)

    dealt = _celled(rows, tree).repartitionByRange(max(1, -(-total // size)), "label", "cell", "key").sortWithinPartitions("label", "cell", "key")
    schema = "pack binary, n int, low long, high long, summary binary, body binary"
    dealt.mapInArrow(pack, schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _pack(table: pa.Table, searcher: Searcher, query: bool) -> pa.RecordBatch:
    table = table.combine_chunks()
    rows, labels = matrix(table.column("vector").chunk(0)), table.column("label").to_numpy()
    order, arrays = (np.arange(len(rows)), searcher.query(rows, labels)) if query else searcher.shard(rows, labels)
    held, largest = rows[order], np.abs(rows).max(initial=0)
    ids = [table.column("ids")[int(i)].as_py() for i in order]
    known = [[i for i in own if i is not None] for own in ids]
    arrays |= {
        "rows": held.astype(np.int32) if largest < 1 << 31 else held, "labels": labels[order], "key": np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(len(rows), -1)[order],
        "id": np.array([i for own in known for i in own], np.int64), "ids_end": np.cumsum([len(own) for own in known]), "nulls": np.array([len(a) - len(b) for a, b in zip(ids, known)]),
    }
    summary = {k: arrays.pop(k) for k in [k for k in arrays if k.startswith("sum_")]} | {"low": labels.min(), "high": labels.max()}
    columns = [[table.column("key")[0].as_py()], [len(rows)], [int(labels.min())], [int(labels.max())], [to_bytes(**summary)], [to_bytes(**arrays)]]
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["pack", "n", "low", "high", "summary", "body"])


def _pairs(shards: DataFrame, blocks: DataFrame, n_shards: int, searcher: Searcher) -> DataFrame:
    """``block``, ``shard``, ``bound`` and its ``rank`` within the block; a block meets many shards' summaries at once."""
    packs = max(1, -(-n_shards // PACK_SHARDS))
    summaries = shards.select(F.pmod(F.xxhash64("pack"), F.lit(packs)).cast("int").alias("at"), F.struct(F.col("pack").alias("shard"), "summary").alias("one")).groupBy("at").agg(F.collect_list("one").alias("all"))
    asked = blocks.select(F.col("pack").alias("block"), "body", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, found in zip(*(batch.column(c).to_pylist() for c in ("block", "body", "all"))):
                bound = searcher.bounds(from_bytes(body), [from_bytes(x["summary"]) for x in found]).max(axis=0)
                held = np.flatnonzero(bound > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(held), pa.binary()), pa.array([found[k]["shard"] for k in held], pa.binary()), pa.array(bound[held])], names=["block", "shard", "bound"])

    met = asked.join(summaries, "at").select("block", "body", "all").mapInArrow(run, "block binary, shard binary, bound double")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("bound"), "shard"))).checkpoint()


class Best:
    """The best rows of an ask so far."""

    def __init__(self, lo: int, hi: int, keep: int):
        self.lo, self.hi, self.keep = lo, hi, keep
        self.rows: list[tuple[int, bool, int]] = []

    def add(self, score: int, ids: list[int], nulls: int) -> None:
        self.rows += [(-score, False, i) for i in ids] + [(-score, True, 0)] * nulls
        self.rows.sort()
        del self.rows[self.keep :]
        if len(self.rows) == self.keep:
            self.lo = max(self.lo, -self.rows[-1][0])


def search_block(shard: dict[str, np.ndarray], block: dict[str, np.ndarray], asks: list[dict], keep: int, searcher: Searcher) -> Iterator[tuple[int, int, int, int | None]]:
    """``q``, ``ask``, score and id of the best rows of a shard for each ask of a block."""
    width = max(shard["rows"].shape[1], block["rows"].shape[1])
    rows, queries = widened(shard["rows"], width).astype(np.float64 if np.abs(shard["rows"]).max(initial=0) < 1 << 53 else np.int64), widened(block["rows"], width)
    largest = float(np.abs(shard["rows"]).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, width)
    starts = np.concatenate([[0], shard["ids_end"]])
    by_query: dict[int, list[tuple[int, Best]]] = {}
    for a in asks:
        by_query.setdefault(a["q"], []).append((a["ask"], Best(a["lo"], a["hi"], keep)))
    for q, own in by_query.items():
        window = [min(b.lo for _, b in own), max(b.hi for _, b in own)]
        for places in searcher.visit(shard, block, q, window):
            scores = products(rows[places], queries[q], largest)
            hit = np.flatnonzero((scores >= window[0]) & (scores <= window[1]))
            for k in hit[np.argsort(-scores[hit], kind="stable")]:
                s, p = int(scores[k]), int(places[k])
                for _, best in own:
                    if best.lo <= s <= best.hi:
                        best.add(s, shard["id"][starts[p] : starts[p + 1]].tolist(), int(shard["nulls"][p]))
            window[0] = min(b.lo for _, b in own)
        for ask, best in own:
            for score, null, i in best.rows:
                yield q, ask, -score, None if null else i


_FOUND = "block binary, q int, ask int, score long, id long"


def search(shards: DataFrame, blocks: DataFrame, asks: DataFrame, keep: int, searcher: Searcher) -> DataFrame:
    """``block``, ``q``, ``ask``, ``score``, ``id``, ``rank`` from 1: the ``keep`` best rows of each ask (``block``, ``q``, ``ask``, ``lo``, ``hi``)."""
    spark = shards.sparkSession
    checkpoint_dir(spark)
    n_shards, n_blocks = shards.count(), blocks.count()
    groups = max(1, -(-n_blocks // GROUP_BLOCKS))
    parts = min(10_000, max(4 * n_shards * groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pairs = _pairs(shards, blocks, n_shards, searcher)
    found, after = spark.createDataFrame([], f"{_FOUND}, rank int"), 0
    for last in WAVES:
        if after >= n_shards:
            break
        due = pairs.where((F.col("rank") > after) & (F.lit(True) if last is None else F.col("rank") <= last)).select("block", "shard", "bound")
        reached = found.where(F.col("rank") == keep).select("block", "q", "ask", F.col("score").alias("reached"))
        now = asks.join(reached, ["block", "q", "ask"], "left").withColumn("lo", F.greatest("lo", F.coalesce("reached", "lo")))
        state = now.where("lo <= hi").groupBy("block").agg(F.min("lo").alias("least"), F.collect_list(F.struct("q", "ask", "lo", "hi")).alias("asks"))
        due = due.join(state, "block").where(F.col("bound") >= F.col("least")).drop("bound", "least")
        share = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("share")
        sent = due.join(blocks.select(F.col("pack").alias("block"), "body"), "block").select("shard", share, F.lit(1).alias("kind"), "block", "body", "asks")
        wanted = due.select("shard", share).distinct()
        held = shards.select(F.col("pack").alias("shard"), "body").join(wanted, "shard").select("shard", "share", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("block"), "body")
        stream = held.unionByName(sent, allowMissingColumns=True).repartition(parts, "shard", "share").sortWithinPartitions("shard", "share", "kind", "block")
        fresh = stream.mapInArrow(_worker(keep, searcher), _FOUND)
        place = F.row_number().over(Window.partitionBy("block", "q", "ask").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        found = found.drop("rank").unionByName(fresh).withColumn("rank", place).where(F.col("rank") <= keep).checkpoint()
        after = last or n_shards
    return found


def _worker(keep: int, searcher: Searcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[str, np.ndarray] = {}
        for batch in batches:
            for kind, block, body, asks in zip(*(batch.column(c) for c in ("kind", "block", "body", "asks"))):
                if kind.as_py() == 0:  # a shard stands before the blocks that ask it
                    shard = from_bytes(body.as_py())
                    continue
                rows = list(search_block(shard, from_bytes(body.as_py()), asks.as_py(), keep, searcher))
                q, ask, score, ids = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(rows), pa.binary()), pa.array(q, pa.int32()), pa.array(ask, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], names=["block", "q", "ask", "score", "id"])

    return run


def places(blocks: DataFrame) -> DataFrame:
    """``block``, ``q``, ``key``: the queries of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(*(batch.column(c).to_pylist() for c in ("pack", "body"))):
                keys = from_bytes(body)["key"]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.binary()), pa.array(range(len(keys)), pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary())], names=["block", "q", "key"])

    return blocks.select("pack", "body").mapInArrow(run, "block binary, q int, key binary")


def index(found: DataFrame, asked: DataFrame, searcher: Searcher, name: str) -> tuple[DataFrame, DataFrame]:
    """Shards of all classes, and blocks of those of them whose ``key`` is in ``asked``."""
    spark = found.sparkSession
    tree = spaces(found)
    shards = packed(found, SHARD_ROWS, searcher, tree, False, scratch_path(spark, f"{name}-shards"))
    blocks = packed(found.join(asked.select("key").distinct(), "key", "left_semi"), BLOCK_ROWS, searcher, tree, True, scratch_path(spark, f"{name}-blocks"))
    return shards, blocks


def without_own(entries: Column, id_: Column, score: Column, keep: int) -> Column:
    """The first ``keep`` of ``entries`` (``score``, ``id``) when one entry of this id and score, the row itself, is left out."""
    own = F.array_position(F.transform(entries, lambda e: e["id"].eqNullSafe(id_) & (e["score"] == score)), True)
    left = F.filter(entries, lambda e, k: (own == 0) | (k != own - 1))
    return F.slice(left, 1, keep)
