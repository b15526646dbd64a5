"""Language identification in two steps: the language family first, then the languages within it.

Features are the shares of hashed letter sequences (1 to 3 letters, words marked by blanks) in a text.  Families are
told apart by logistic models, one against the rest; within a family every two languages are separated by a linear
support vector machine, whose calibrated margins are averaged.  All models are linear, so a text is scored by
adding up the weights of its sequences, block by block, whatever its length.

These models tell learned languages apart; whether a text is in any of them, ``typical`` says: the mean log-likelihood
of its sequences in the predicted language mustn't lie further below that of the training texts than chance explains
for so many sequences.

Defined results: a null text, or one without a letter, is ``und`` with score 0; learned languages are those of the
training rows, and a single one is predicted with score 1; without a training row every text is ``und``; repeated
rows each give their own result; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.linear import Dense, fit, sample_by_class, sigmoid
from sylva.llm.tables import fresh

#: Texts of each language that the models are fitted on, of all languages together, and the hashed features.
SAMPLE, SAMPLE_ROWS, DIMENSIONS = 400, 8_000, 1 << 12
UNKNOWN = "und"
#: Letters of a training text that are shown to the models a second time as a short text.
SNIPPET = 80
#: How many times the usual spread a typical text's likelihood may lie below the usual one; the given texts stay within 11.4.
SLACK = 12.0
_BLOCK = 1 << 19
#: Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
    "sinitic": ("zh", "yue"),
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0].split("_")[0] in codes), f"only {lang}")


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def sequences(text: str) -> Iterator[np.ndarray]:
    """Hashed sequences of a text, in blocks of bounded length; none without a letter."""
    for at in range(0, len(text), _BLOCK):
        part = text[max(0, at - 2) : at + _BLOCK].lower()
        codes = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[codes]
        codes = np.where(letter, codes, np.uint32(32))
        with np.errstate(over="ignore"):
            a, b, c = (codes * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
            one, two, three = a[1:-1] ^ (a[1:-1] >> np.uint32(15)), a[1:-1] + b[2:], a[:-2] + b[1:-1] + c[2:]
            inner = letter[1:-1]
            mixed = np.concatenate([(x[inner] ^ np.uint32(s)) * np.uint32(0x27D4EB2F) for x, s in ((one, 1), (two, 2), (three, 3))])
        yield (mixed >> np.uint32(20)).astype(np.int64)


assert 1 << (32 - 20) == DIMENSIONS


def shares(text: str | None) -> np.ndarray | None:
    """The share of each hashed sequence, or None without a letter."""
    counts = np.zeros(DIMENSIONS)
    for h in sequences(text or ""):
        counts += np.bincount(h, minlength=DIMENSIONS)
    total = counts.sum()
    return counts / total if total else None


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    #: One column for each family's model, then for each pair of languages of a family.
    weights: np.ndarray
    biases: np.ndarray
    pairs: list[tuple[int, int]]
    #: Of each language the log-likelihoods of the sequences, their mean in its texts, and its spread by length.
    likelihood: np.ndarray
    usual: np.ndarray
    spread: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its score, and whether the text is typical of it."""
        if not self.langs:
            return UNKNOWN, 0.0, False
        total, likely, n = np.zeros(self.weights.shape[1]), np.zeros(len(self.langs)), 0
        for h in sequences(text or ""):
            # weights of few columns: counting first makes one small product of it
            counts = np.bincount(h, minlength=DIMENSIONS)
            total += counts @ self.weights
            likely += counts @ self.likelihood
            n += len(h)
        if not n:
            return UNKNOWN, 0.0, False
        margins = total / n + self.biases
        names = sorted(set(self.families))
        p = sigmoid(margins[: len(names)]) if len(names) > 1 else np.ones(1)
        family = int(np.argmax(p))
        p_family = p[family] / p.sum() if p.sum() > 0 else 0.0
        own = [k for k, f in enumerate(self.families) if f == names[family]]
        votes = dict.fromkeys(own, 0.0)
        for (i, j), margin in zip(self.pairs, margins[len(names) if len(names) > 1 else 0 :]):
            if i in votes:
                win = float(sigmoid(2 * margin))
                votes[i] += win
                votes[j] += 1 - win
        best = max(own, key=lambda k: (votes[k], -k))
        within = votes[best] / (len(own) - 1) if len(own) > 1 else 1.0
        typical = likely[best] / n >= self.usual[best] - SLACK * (self.spread[best, 0] + self.spread[best, 1] / np.sqrt(n))
        return self.langs[best], float(min(1.0, max(0.0, p_family * within))), bool(typical)


def fit_model(x: np.ndarray, lang: list[str], sizes: np.ndarray | None = None) -> Model:
    """Fits rows of :func:`shares`, their languages and numbers of sequences; scales ``x`` in place."""
    langs = sorted(set(lang))
    likelihood, usual, deviations = _typicality(x, np.array([langs.index(k) for k in lang], dtype=int), np.ones(len(x)) if sizes is None else sizes, len(langs))
    families = [family_of(k) for k in langs]
    names = sorted(set(families))
    spread = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-6 if len(x) else np.ones(x.shape[1])
    x /= spread.astype(x.dtype)
    y = np.array([langs.index(k) for k in lang])
    columns, biases = [], []

    def add(positive: np.ndarray, negative: np.ndarray, loss: str) -> None:
        # classes weigh the same whatever their number of rows; other rows weigh nothing, so that none is copied
        weights = positive * (0.5 / max(1, positive.sum())) + negative * (0.5 / max(1, negative.sum()))
        w, b = fit(Dense(x), np.where(positive, 1.0, -1.0), weights, loss, l2=1e-3, rounds=80)
        columns.append(w / spread)
        biases.append(b)

    if len(names) > 1:
        of_row = np.array([families[k] for k in y])
        for f in names:
            add(of_row == f, of_row != f, "logistic")
    pairs = [(i, j) for i, j in itertools.combinations(range(len(langs)), 2) if families[i] == families[j]]
    for i, j in pairs:
        add(y == i, y == j, "hinge")
    return Model(langs, families, np.array(columns).T.reshape(x.shape[1], -1), np.array(biases), pairs, likelihood, usual, deviations)


def _typicality(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods by language, and the mean and the spread (fixed, and by the root of the length) of its texts'."""
    likelihood, usual, spread = np.zeros((x.shape[1], n_langs)), np.zeros(n_langs), np.zeros((n_langs, 2))
    for k in range(n_langs):
        own = x[y == k]
        p = own.mean(axis=0, dtype=float) + 0.05 / x.shape[1]
        likelihood[:, k] = np.log(p / p.sum())
        got = own @ likelihood[:, k]
        usual[k] = np.average(got, weights=sizes[y == k])
        off, size = np.abs(got - usual[k]), sizes[y == k]
        long = size >= np.median(size)
        # halves of the distances that one in twenty exceeds: a few odd texts don't widen them
        spread[k] = [np.quantile(v, 0.95) / 2 if len(v) else 0.0 for v in (off[long], off[~long] * np.sqrt(size[~long]))]
    return likelihood, usual, spread


def train(docs: DataFrame, train_rows, most: int = SAMPLE) -> Model:
    """Fits on about ``most`` texts of each language among the rows with a language for which ``train_rows`` holds.

    All languages are learned; of more than 20 each gives fewer texts, so that the sample stays within ``SAMPLE_ROWS``.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & train_rows)
    chosen, _ = sample_by_class(rows, "lang", most, "language", SAMPLE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sizes, found = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                middle = len(text or "") // 2
                for t in (text, (text or "")[middle : middle + SNIPPET]):
                    x = shares(t)
                    if x is not None:
                        langs.append(lang)
                        # most shares are nought
                        found.append(zlib.compress(x.astype("<f4").tobytes(), 1))
                        sizes.append(sum(len(h) for h in sequences(t)))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["lang", "size", "shares"])

    got = sorted((r["lang"], r["size"], bytes(r["shares"])) for r in chosen.select("lang", "text").mapInArrow(run, "lang string, size long, shares binary").collect())
    x = np.empty((len(got), DIMENSIONS), dtype=np.float32)
    for k, (_, _, row) in enumerate(got):
        x[k] = np.frombuffer(zlib.decompress(row), dtype="<f4")
    langs, sizes = [g[0] for g in got], np.array([g[1] for g in got], dtype=float)
    del got
    return fit_model(x, langs, sizes)


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes) -> Model:
    return pickle.loads(model)


def predict(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """``docs`` with a column ``into``: struct of ``lang``, ``score`` and ``typical``."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("typical", pa.bool_())])
    result = docs.withColumn(into, F.lit(None).cast("struct<lang: string, score: double, typical: boolean>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(sent.value)
        for batch in batches:
            found = [dict(zip(("lang", "score", "typical"), own.predict(t))) for t in batch.column("text").to_pylist()]
            columns = [pa.array(found, kind) if c == into else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return result.mapInArrow(run, result.schema)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that have no letter or aren't typical of the language that is the likeliest."""
    into = fresh("language", docs.columns)
    return predict(docs, model, into).where(F.col(into)["typical"]).select(*docs.columns)
