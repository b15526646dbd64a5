"""Toxicity: a linear classifier on words, regularised by counterfactuals.

Features are the different words of a text and their first 4 to 7 letters; a text's score adds up the weights of its
different words, so a few words decide however long the text is.  In training, identity terms in the labelled
texts are swapped for other terms of their kind and the squared change of the score is penalised, as is the
difference between any two terms, so that a group's mention does not move the score.

Defined results: a null text scores as an empty one; without a labelled row of either class all texts score the
share of the class there is (0 if there is none); a document with several labels has the largest; repeated rows
each give their own result; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.linear import Sparse, fit, labelled, sigmoid
from sylva.llm.tables import checkpoint_dir

#: Labelled texts of each class that the model is fitted on, features it keeps, and how strongly swaps are penalised.
SAMPLE, FEATURES, SWAP_WEIGHT = 2_500, 4_000, 10.0
PREFIXES = (4, 5, 6, 7)
#: A feature is learned if this many texts have it and the classes' shares of it differ by this many standard errors.
LEAST_TEXTS, LEAST_Z = 4, 2.5
#: Terms that name groups of people, by kind; a swap stays within its kind.
IDENTITY_TERMS = {
    "gender": ("woman", "man", "women", "men", "girl", "boy", "female", "male", "transgender", "nonbinary", "femme", "homme", "frau", "mann", "mujer", "hombre"),
    "faith": ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "musulman", "juif", "chrétien", "muslimisch", "jüdisch", "musulmán", "judío", "cristiano"),
    "origin": ("black", "white", "asian", "african", "european", "latino", "arab", "american", "indian", "chinese", "mexican", "turkish", "polish", "immigrant", "refugee"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    "other": ("disabled", "blind", "deaf", "autistic", "old", "young", "elderly", "poor", "rich"),
}
_WORD = re.compile(r"[^\W\d_]+")
_WORDS_KEPT = 400_000


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[int]:
    import xxhash

    parts = [word + "$", *("^" + word[:k] for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh64_intdigest(p) for p in parts]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    per_word: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def _word(self, word: str) -> float:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        s = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return s

    def score(self, text: str | None) -> float:
        words, known = text_words(text), self.known
        total = sum([known[w] if w in known else self._word(w) for w in sorted(words)])
        return float(sigmoid(np.float64(self.bias + self.per_word * np.log1p(len(words)) + total)))


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows, most: int = SAMPLE) -> Model:
    """Fits on about ``most`` labelled documents of each class among ``train_rows`` of ``labels``.

    Spark counts the features and chooses those that are learned; of a text only these come to the driver, however
    long it is.
    """
    checkpoint_dir(docs.sparkSession)
    rows, counts = labelled(docs, labels, label, train_rows, most, "toxicity")
    rows = rows.select("y", "text").checkpoint()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                found = np.unique(_hashes(text_words(text))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), y, np.int32))], names=["feature", "y"])

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    found = rows.mapInArrow(seen, "feature long, y int").groupBy("feature").agg(F.count("*").alias("has"), F.sum("y").alias("has1"))
    p = F.col("has") / (n1 + n0)
    z = F.abs((F.col("has1") / n1 - (F.col("has") - F.col("has1")) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12))
    chosen = found.withColumn("z", z).where(f"has >= {LEAST_TEXTS} and z > {LEAST_Z}").orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    features = np.sort(np.array([r["feature"] for r in chosen], dtype=np.int64).view(np.uint64))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sample_row(y, text, features) for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist())]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())))], names=["y", "n_words", "columns", "times", "swaps"])

    got = rows.mapInArrow(shown, "y int, n_words long, columns array<int>, times array<int>, swaps array<string>").collect()
    return fit_model(sorted((r["y"], r["n_words"], tuple(r["columns"]), tuple(r["times"]), tuple(r["swaps"])) for r in got), features, counts)


def _hashes(words) -> np.ndarray:
    return np.array([f for w in words for f in word_features(w)], dtype=np.uint64)


def sample_row(y: int, text: str | None, features: np.ndarray) -> tuple:
    """A text as the model is shown it: label, words, learned features, words that have each, and possible swaps."""
    words = sorted(text_words(text))
    of = _hashes(words)
    at = np.searchsorted(features, of)
    here = at[(at < len(features)) & (features[np.minimum(at, len(features) - 1)] == of)] if len(features) else at[:0]
    columns, times = np.unique(here, return_counts=True)
    return y, len(words), tuple(columns.tolist()), tuple(times.tolist()), tuple(f"{a} {b}" for a, b in _swaps(words))


def _swaps(words: list[str]) -> list[tuple[str, str]]:
    present = set(words)
    return [(a, b) for terms in IDENTITY_TERMS.values() for a in terms if a in present for b in terms if b not in present]


def fit_model(sample: list[tuple], features: np.ndarray, counts: dict[int, int]) -> Model:
    """Fits rows of :func:`sample_row`; ``counts`` are the classes' true counts, which the sample is weighted to."""
    total = sum(counts.values())
    y = np.array([1 if s[0] else -1 for s in sample])
    if not len(y) or abs(y.sum()) == len(y):
        share = counts.get(1, 0) / total if total else 0.0
        return Model({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    n1, n0, d = (y > 0).sum(), (y < 0).sum(), len(features) + 1
    rows = np.repeat(np.arange(len(sample)), [len(s[2]) for s in sample])
    columns, times = (np.array([v for s in sample for v in s[k]], dtype=np.int64) for k in (2, 3))
    log_words = np.log1p([s[1] for s in sample])
    x = Sparse(np.concatenate([rows, np.arange(len(y))]), np.concatenate([columns, np.full(len(y), d - 1)]), np.concatenate([times.astype(float), log_words / 5]), (len(y), d))
    index = {int(h): k for k, h in enumerate(features)}
    pairs = [tuple(s.split(" ", 1)) for *_, swaps in sample for s in swaps]
    pairs += [(a, b) for terms in IDENTITY_TERMS.values() for a in terms for b in terms if a < b]
    equal = _differences(pairs, index, d)
    weights = np.where(y > 0, counts[1] / n1, counts[0] / n0)
    w, b = fit(x, y, weights, l2=2e-4, rounds=600, equal=equal, equal_weight=SWAP_WEIGHT)
    return Model({h: float(w[k]) for h, k in index.items() if w[k]}, float(b), float(w[d - 1] / 5))


def _differences(pairs: list[tuple[str, str]], index: dict[int, int], d: int) -> Sparse:
    """One row for each swap: what it takes from the features and adds to them."""
    rows, columns, values = [], [], []
    for k, (a, b) in enumerate(pairs):
        for word, sign in ((a, -1.0), (b, 1.0)):
            for c in (index[f] for f in word_features(word) if f in index):
                rows.append(k)
                columns.append(c)
                values.append(sign)
    return Sparse(np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(values), (len(pairs), d))


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(sent.value)
        for batch in batches:
            scores = [own.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
