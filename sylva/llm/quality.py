"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles of a labelled sample.  Boosting goes round the features, and for
each adds a shallow tree over its bins to that feature's lookup table, at a low rate, so that correlated features share
the effect.  Then the pairs that explain most of what is left are ranked and boosted in the same way, with trees of one cut on
either feature.  A text's score is the sum of its bins' entries.

Defined results: a null text scores as an empty one; without a labelled row of either class all texts score the share
of the class there is (0 if there is none); a document with several labels has the largest; repeated rows each give
their own result; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import itertools
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.linear import labelled, sigmoid

#: Labelled texts of each class that the model is fitted on.
SAMPLE = 6_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 12, 240, 120, 10, 0.08
FEATURES = (
    "log_words", "word_length", "upper", "digits", "sentence_signs", "shouts", "bars", "other_signs", "quotes", "non_ascii",
    "different_words", "same_as_before", "top_word", "short_words", "capitals", "signed_words", "log_lines", "line_words", "repeated_lines", "different_letters",
)
_GROUPS = {"digits": "0123456789", "sentence_signs": ".,;:?", "shouts": "!", "bars": "|", "other_signs": "#$%&*@^~=+<>/\\_`{}", "quotes": "\"'()[]"}


def features(text: str | None) -> list[float]:
    """The values of :data:`FEATURES`."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    m = max(1, len(words))
    counts = Counter(words)
    group = {k: sum(int(seen[ord(c)]) for c in v) / n for k, v in _GROUPS.items()}
    same = sum(a == b for a, b in zip(words, words[1:]))
    lengths = list(map(len, words))
    signed = sum(k for c, k in Counter(w[-1] for w in words).items() if not c.isalnum() and c not in "_.,;:?")
    return [
        float(np.log1p(len(words))), sum(lengths) / m, int(seen[65:91].sum()) / n, group["digits"], group["sentence_signs"], group["shouts"], group["bars"], group["other_signs"], group["quotes"], int(seen[128:].sum()) / n,
        len(counts) / m, same / m, max(counts.values(), default=0) / m, sum(x <= 3 for x in lengths) / m, sum(map(str.istitle, words)) / m, signed / m,
        float(np.log1p(len(lines))), len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), int((seen > 0).sum()) / np.sqrt(n),
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features: additions of table entries."""
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], side="right") for i, j, _ in self.pairs for k in (i, j)}
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return sigmoid(total)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins, given the sums of gradients and curvatures in each: its value in each bin."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    cut = 1 + int(np.argmax(_gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl)))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of one cut on either axis over a grid of bins: its values, and what it explains."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        low = c[:-1, :-1]
        parts.append((low, c[:-1, -1:] - low, c[-1:, :-1] - low, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + low))
    gain = sum(_gain(a, b) for a, b in zip(*parts))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    table = np.empty(g.shape)
    for (rows, columns), a, b in zip(itertools.product((slice(None, i + 1), slice(i + 1, None)), (slice(None, j + 1), slice(j + 1, None))), parts[0], parts[1]):
        table[rows, columns] = _leaf(a[i, j], b[i, j])
    return table, float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1]))


def fit_model(x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> Model:
    """Fits rows of features and labels 0 or 1; ``counts`` are the classes' true counts, which the sample is weighted to."""
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    if not len(y) or y.min() == y.max():
        return Model([], [], [], [], base)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    weight = weight / weight.mean()
    d = x.shape[1]
    cuts, pair_cuts = [_cuts(x[:, k], BINS) for k in range(d)], [_cuts(x[:, k], PAIR_BINS) for k in range(d)]
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    f = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(f)
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(d):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[k], g, len(tables[k])), np.bincount(bins[k], h, len(tables[k])))
            tables[k] += step
            f += step[bins[k]]

    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(pair_cuts)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        width = len(pair_cuts[j]) + 1
        return np.bincount(coarse[i] * width + coarse[j], v, (len(pair_cuts[i]) + 1) * width).reshape(-1, width)

    g, h = slopes()
    possible = [(i, j) for i, j in itertools.combinations(range(d), 2) if len(pair_cuts[i]) and len(pair_cuts[j])]
    ranked = sorted(possible, key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[1])[:PAIRS]
    pairs = [(i, j, np.zeros((len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[0]
            table += step
            f += step[coarse[i], coarse[j]]
    return Model(cuts, tables, pair_cuts, pairs, base)


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows, most: int = SAMPLE) -> Model:
    """Fits on about ``most`` labelled documents of each class among ``train_rows`` of ``labels``."""
    rows, counts = labelled(docs, labels, label, train_rows, most, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.float64()))], names=["y", "features"])

    got = sorted((r["y"], tuple(r["features"])) for r in rows.select("y", "text").mapInArrow(run, "y int, features array<double>").collect())
    return fit_model(np.array([r[1] for r in got], dtype=float).reshape(-1, len(FEATURES)), np.array([r[0] for r in got], dtype=int), counts)


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(sent.value)
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
