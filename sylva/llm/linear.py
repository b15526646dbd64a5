"""Linear models on a bounded sample: accelerated gradient descent on the driver, and sampling of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHARES = 1 << 30


@dataclass
class Sparse:
    """A matrix as coordinates."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * w[self.columns], minlength=self.shape[0])

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=self.values * r[self.rows], minlength=self.shape[1])


@dataclass
class Dense:
    x: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return self.x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w.astype(self.x.dtype)

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return r.astype(self.x.dtype) @ self.x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(x, y: np.ndarray, weights: np.ndarray, loss: str = "logistic", l2: float = 1e-3, rounds: int = 200, equal: Sparse | None = None, equal_weight: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias for ``y`` in (-1, 1) by Nesterov's method; ``loss`` is ``logistic`` or ``hinge`` (squared).

    ``equal`` has differences of inputs that should score alike: the mean square of their scores is penalised with
    ``equal_weight``.
    """
    n, d = x.shape
    weights = weights / weights.sum()
    v, scale = np.random.default_rng(0).normal(size=d), 1.0
    for _ in range(20):
        u = x.tdot(weights * x.dot(v)) + (equal_weight / max(1, equal.shape[0]) * 2 * equal.tdot(equal.dot(v)) if equal is not None else 0)
        scale = float(np.linalg.norm(u))
        v = u / max(scale, 1e-12)
    curvature = 0.25 if loss == "logistic" else 2.0
    step = 1.0 / (curvature * (scale + 1.0) * 1.2 + l2 + scale * bool(equal_weight))

    w, b = np.zeros(d), 0.0
    w0, b0, t0 = w, b, 1.0
    for _ in range(rounds):
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        vw, vb = w + (t0 - 1) / t1 * (w - w0), b + (t0 - 1) / t1 * (b - b0)
        margin = y * (x.dot(vw) + vb)
        slope = -y * (sigmoid(-margin) if loss == "logistic" else 2 * np.maximum(0, 1 - margin)) * weights
        g = x.tdot(slope) + l2 * vw
        if equal is not None and equal.shape[0]:
            g = g + 2 * equal_weight / equal.shape[0] * equal.tdot(equal.dot(vw))
        w0, b0, t0 = w, b, t1
        w, b = vw - step * g, vb - step * slope.sum()
    return w, b


def share(doc_id: Column, salt: str) -> Column:
    """A number from 0 up to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(_SHARES)) / F.lit(float(_SHARES))


#: More different labels than this aren't classes, but a column that holds something else.
MOST_CLASSES = 10_000


def sample_by_class(rows: DataFrame, label: str, most: int, salt: str, most_rows: int | None = None) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each class (all if there are fewer), chosen by their ids' hash, and the classes' counts.

    Every class is learned; of many classes each gives fewer rows, so that all give about ``most_rows`` together.  An id that
    many rows of the sample share gives the row of the smallest hash.  Of each class only the count comes to the driver.
    """
    found = rows.where(F.col(label).isNotNull()).groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} different values, which are no classes")
    counts = {r[label]: r["count"] for r in sorted(found, key=lambda r: (-r["count"], r[label]))}
    if not counts:
        return rows.limit(0), counts
    if most_rows is not None:
        most = max(1, min(most, most_rows // len(counts)))
    shares = F.create_map(*(F.lit(x) for value, n in counts.items() for x in (value, min(1.0, most / n))))
    chosen = rows.where(share(F.col("doc_id"), salt) < F.element_at(shares, F.col(label)))
    others = [c for c in rows.columns if c != "doc_id"]
    row = F.struct(F.xxhash64(*others).alias("hash"), F.struct(*others).alias("row"))
    return chosen.groupBy("doc_id").agg(F.min(row).alias("least")).select("doc_id", "least.row.*"), counts


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, salt: str) -> tuple[DataFrame, dict]:
    """``doc_id``, ``text``, ``y`` of about ``most`` labelled documents of each class, and the classes' counts.

    A document labelled more than once has the largest of its labels, and one of several rows the text of the smallest hash.
    The sample of labels is bounded by ``most`` and is broadcast.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen, counts = sample_by_class(one, "y", most, salt)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "y")).alias("least")
    return met.groupBy("doc_id").agg(least).select("doc_id", "least.text", "least.y"), counts
