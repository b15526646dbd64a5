"""Hard-negative mining by angular triangle filtering.

Every row has stored angles to a few reference directions.  The angle between an anchor and a row is no less than the
difference of their angles to any reference and no more than their sum (or what it lacks of a full turn), which gives
an interval of cosines and, times the lengths, a window of scores.  Rows whose window doesn't overlap the scores that
are asked for are never scored.  The same windows hold for runs of rows, which are tried first, and for whole shards.

An anchor's positives are its best rows of the same label; for each different score of theirs the best rows of other
labels within a share of that score are sought (see :mod:`sylva.llm.vectors`, also for nulls, ties and odd vectors).

Defined results: rows without a label take no part; an anchor's own row is never its positive, but rows that repeat it are;
anchors that repeat each give their rows; a positive without a negative in its window gives none; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm import vectors
from sylva.llm.tables import checkpoint_dir, fresh, spread_join

RUN_ROWS, REFERENCES = 128, 8
#: By how much intervals of angles are widened: more than the error of an arc cosine near its ends.
_ANGLE = 1e-7


def references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors, each the one of the sample that is farthest from those before; ``sample`` may hold zeros."""
    length = np.sqrt((sample**2).sum(axis=1))
    unit = sample[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.zeros((1, max(1, sample.shape[1])))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


class Angles:
    """Bounds by angles to ``directions``; ``same``: whether rows of the query's label are asked for, or of others."""

    def __init__(self, directions: np.ndarray, same: bool, run_rows: int = RUN_ROWS):
        self.directions, self.same, self.run_rows = directions, same, run_rows

    def _angles(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and angles; a zero vector has a right angle to everything, which its length makes harmless."""
        width = max(rows.shape[1], self.directions.shape[1])
        x = vectors.widened(rows.astype(np.float64), width)
        length = np.sqrt((x * x).sum(axis=1))
        cosine = x @ vectors.widened(self.directions, width).T / np.where(length > 0, length, 1)[:, None]
        return length, np.arccos(np.clip(cosine, -1, 1))

    def shard(self, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        length, angle = self._angles(rows)
        near = angle.argmin(axis=1)
        order = np.lexsort((angle[np.arange(len(rows)), near], near, labels))
        length, angle, own = length[order], angle[order], labels[order]
        at = np.arange(0, len(rows), self.run_rows)
        least, most = (f.reduceat(angle, at, axis=0) for f in (np.minimum, np.maximum))
        short, long_ = (f.reduceat(length, at) for f in (np.minimum, np.maximum))
        ends = np.append(at[1:], len(rows)) - 1
        return order, {
            "length": length, "angle": angle, "run_least": least, "run_most": most, "run_short": short, "run_long": long_, "run_low": own[at], "run_high": own[ends],
            "sum_least": least.min(axis=0), "sum_most": most.max(axis=0), "sum_length": np.array([short.min(), long_.max()]),
        }

    def query(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        length, angle = self._angles(rows)
        return {"length": length, "angle": angle}

    @staticmethod
    def scores(length: np.ndarray, angle: np.ndarray, least: np.ndarray, most: np.ndarray, short: np.ndarray, long_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of a query and rows with angles from ``least`` to ``most`` and lengths from ``short`` to ``long_``."""
        low = np.maximum(angle - most, least - angle).max(axis=-1) - _ANGLE
        high = np.minimum(angle + most, 2 * np.pi - angle - least).min(axis=-1) + _ANGLE
        top, bottom = np.cos(np.clip(low, 0, np.pi)), np.cos(np.clip(high, 0, np.pi))
        slack = 1e-9 * length * long_ + 1e-6
        return length * bottom * np.where(bottom > 0, short, long_) - slack, length * top * np.where(top > 0, long_, short) + slack

    def bounds(self, queries: dict[str, np.ndarray], shards: list[dict[str, np.ndarray]]) -> np.ndarray:
        least, most, length = (np.stack([s[k] for s in shards]) for k in ("sum_least", "sum_most", "sum_length"))
        greatest = self.scores(queries["length"][:, None], queries["angle"][:, None, :], least, most, length[:, 0], length[:, 1])[1]
        low, high = (np.array([int(s[k]) for s in shards]) for k in ("low", "high"))
        return np.where(self._wanted(queries["labels"][:, None], low, high), greatest, -np.inf)

    def _wanted(self, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether labels from ``low`` to ``high`` can hold one that is asked for."""
        return (low <= label) & (label <= high) if self.same else (low != label) | (high != label)

    def visit(self, shard: dict[str, np.ndarray], queries: dict[str, np.ndarray], q: int, window: list[int]) -> Iterator[np.ndarray]:
        length, angle, label = queries["length"][q], queries["angle"][q], queries["labels"][q]
        bottom, top = self.scores(length, angle, shard["run_least"], shard["run_most"], shard["run_short"], shard["run_long"])
        runs = np.flatnonzero(self._wanted(label, shard["run_low"], shard["run_high"]) & (top >= window[0]) & (bottom <= window[1]))
        for r in runs[np.argsort(-top[runs], kind="stable")]:
            if top[r] < window[0]:
                return
            at = np.arange(r * self.run_rows, min((r + 1) * self.run_rows, len(shard["length"])))
            own, long_ = shard["angle"][at], shard["length"][at]
            least, most = self.scores(length, angle, own, own, long_, long_)
            at = at[((shard["labels"][at] == label) == self.same) & (most >= window[0]) & (least <= window[1])]
            if len(at):
                yield at


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), id_: str = "vec_id", vector: str = "embedding", scale: int = 256, run_rows: int = RUN_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Each row for which ``is_anchor`` holds has its ``positives`` best other rows of the same ``label``; each of them gets
    the ``negatives`` best rows of other labels whose score is from ``share[0]`` to ``share[1]`` hundredths of its own.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    asked = fresh("anchor", rows.columns)
    labelled = fresh("own_label", rows.columns)
    rows = rows.withColumns({labelled: label, asked: is_anchor})
    every = vectors.named(rows, F.col(id_), F.col(vector), F.col(labelled), scale)
    anchors = vectors.named(rows.where(F.col(asked)), F.col(id_), F.col(vector), F.col(labelled), scale).select("id", "key", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("own")).checkpoint()
    found = vectors.classes(every, max(positives + 1, negatives)).checkpoint()
    sample = found.orderBy("key").limit(vectors.SAMPLE_ROWS).select("vector").collect()
    directions = references(vectors.matrix(pa.array([r["vector"] for r in sample], pa.list_(pa.int64()))).astype(np.float64))
    near, far = Angles(directions, True, run_rows), Angles(directions, False, run_rows)
    shards, blocks = vectors.index(found, anchors, near, "negatives")
    at = vectors.places(blocks)
    asks = at.select("block", "q", F.lit(0).alias("ask"), F.lit(vectors.LEAST).alias("lo"), F.lit(vectors.MOST).alias("hi"))
    # an anchor's own row is found as well and left out at the end
    best = vectors.search(shards, blocks, asks, positives + 1, near).checkpoint()
    # one ask for each different score: positives of the same score have the same negatives
    lo, hi = F.expr(f"({share[0]} * score + 99) div 100"), F.expr(f"({share[1]} * score) div 100")
    of_score = best.where("score >= 0").groupBy("block", "q", "score").agg(F.min("rank").alias("ask")).withColumns({"lo": lo, "hi": hi}).checkpoint()
    opposite = vectors.search(shards, blocks, of_score.select("block", "q", "ask", "lo", "hi"), negatives, far)
    listed = opposite.groupBy("block", "q", "ask").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("negatives"))
    of_each = listed.join(of_score.select("block", "q", "ask", "score"), ["block", "q", "ask"]).groupBy("block", "q").agg(F.collect_list(F.struct("score", "negatives")).alias("windows"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))), lambda e: F.struct(e["score"].alias("score"), e["id"].alias("id")))
    by_class = best.groupBy("block", "q").agg(entries.alias("entries")).join(of_each, ["block", "q"]).join(at, ["block", "q"]).select("key", "entries", "windows")
    copies = anchors.groupBy("key").agg(F.count("*").alias("copies"))
    met = spread_join(anchors, by_class.join(copies, "key"), ["key"], "copies", anchors.count())
    chosen = met.select("id", F.explode(vectors.without_own(F.col("entries"), F.col("id"), F.col("own"), positives)).alias("positive"), "windows")
    windows = F.filter("windows", lambda w: w["score"] == F.col("positive")["score"])
    out = chosen.select("id", "positive", F.explode(F.get(windows, F.lit(0))["negatives"]).alias("negative"))
    return out.select(F.col("id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), F.col("negative.rank").alias("rank"), F.col("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))
