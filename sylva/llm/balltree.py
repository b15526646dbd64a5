"""Exact top-k search by inner product: a ball tree in each shard, branch and bound.

A node's rows lie in a ball; no row's product with a query is greater than the query's with the centre plus the radius times
the query's length.  A shard's nodes are opened in the order of that bound until it is below the score that the query has
reached, in this shard or in those before it (see :mod:`sylva.llm.vectors`, also for nulls, ties and odd vectors).

Defined results: a row is never a candidate of its own query, but rows that repeat it are; queries that repeat each give
their rows; a query with fewer candidates gives all; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm import vectors
from sylva.llm.tables import checkpoint_dir, spread_join

LEAF_ROWS = 128


class BallTree:
    """Bounds by balls; see :class:`sylva.llm.vectors.Searcher`."""

    def __init__(self, leaf_rows: int = LEAF_ROWS):
        self.leaf_rows = leaf_rows

    def shard(self, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x, order = rows.astype(np.float64), np.arange(len(rows))
        nodes, left, waiting = [(0, len(rows))], [0], [0]
        while waiting:
            node = waiting.pop()
            a, b = nodes[node]
            if b - a <= self.leaf_rows:
                continue
            at = x[order[a:b]] @ vectors.widest(x[order[a:b]])
            order[a:b] = order[a:b][np.argsort(at, kind="stable")]
            left[node] = len(nodes)  # the right one stands behind it
            waiting += [len(nodes), len(nodes) + 1]
            nodes += [(a, (a + b) // 2), ((a + b) // 2, b)]
            left += [0, 0]
        centre = np.stack([x[order[a:b]].mean(axis=0) for a, b in nodes])
        radius = np.array([np.sqrt(((x[order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(nodes, centre)])
        return order, {"nodes": np.array(nodes), "left": np.array(left), "centre": centre, "radius": radius, "sum_centre": centre[0], "sum_radius": radius[:1]}

    def query(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        return {}

    def _bound(self, queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Rounded up by far more than the error of doubles."""
        width = max(queries.shape[1], centre.shape[1])
        q, c = vectors.widened(queries.astype(np.float64), width), vectors.widened(centre, width)
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        size = length * (np.sqrt((c * c).sum(axis=1)) + radius)
        return q @ c.T + length * radius + 1e-9 * size + 1e-6

    def bounds(self, queries: dict[str, np.ndarray], shards: list[dict[str, np.ndarray]]) -> np.ndarray:
        width = max(len(s["sum_centre"]) for s in shards)
        centre = np.stack([np.pad(s["sum_centre"], (0, width - len(s["sum_centre"]))) for s in shards])
        return self._bound(queries["rows"], centre, np.concatenate([s["sum_radius"] for s in shards]))

    def visit(self, shard: dict[str, np.ndarray], queries: dict[str, np.ndarray], q: int, window: list[int]) -> Iterator[np.ndarray]:
        bound, nodes, left = self._bound(queries["rows"][q : q + 1], shard["centre"], shard["radius"])[0].tolist(), shard["nodes"], shard["left"]
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= window[0]:
            node = heapq.heappop(heap)[1]
            if left[node]:
                for child in (int(left[node]), int(left[node]) + 1):
                    heapq.heappush(heap, (-bound[child], child))
            else:
                yield np.arange(*nodes[node])


def top_k(rows: DataFrame, is_query: Column, k: int, id_: str = "vec_id", vector: str = "embedding", scale: int = 256, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the ``k`` best other rows of each row for which ``is_query`` holds.

    The score is the inner product of ``floor(scale * x)``; ties go to the smaller id.
    """
    spark, searcher = rows.sparkSession, BallTree(leaf_rows)
    checkpoint_dir(spark)
    every = vectors.named(rows, F.col(id_), F.col(vector), F.lit(0), scale)
    queries = vectors.named(rows.where(is_query), F.col(id_), F.col(vector), F.lit(0), scale).select("id", "key", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("own")).checkpoint()
    # a query's own row is found as well and left out at the end
    found = vectors.classes(every, k + 1).checkpoint()
    shards, blocks = vectors.index(found, queries, searcher, "top-k")
    at = vectors.places(blocks)
    asks = at.select("block", "q", F.lit(0).alias("ask"), F.lit(vectors.LEAST).alias("lo"), F.lit(vectors.MOST).alias("hi"))
    best = vectors.search(shards, blocks, asks, k + 1, searcher)
    entries = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))), lambda e: F.struct(e["score"].alias("score"), e["id"].alias("id")))
    by_class = best.groupBy("block", "q").agg(entries.alias("entries")).join(at, ["block", "q"]).select("key", "entries")
    copies = queries.groupBy("key").agg(F.count("*").alias("copies"))
    met = spread_join(queries, by_class.join(copies, "key"), ["key"], "copies", queries.count())
    each = met.select(F.col("id").alias("query_id"), F.posexplode(vectors.without_own(F.col("entries"), F.col("id"), F.col("own"), k)).alias("place", "entry"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("entry.id").alias("vec_id"), F.col("entry.score").alias("score"))
