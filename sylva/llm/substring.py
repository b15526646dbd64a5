"""Exact substring deduplication: Rabin-Karp hashes of every fixed-length window of words.

Documents are dealt to blocks of bounded size.  Three passes over the blocks, which share one shuffle of the texts:

1. A window's anchor is the least hash among its sub-windows of half its length; equal windows have equal anchors.
   Spark finds the anchors that occur in two documents.  This passes on one in thirteen places only, and no
   window that repeats can lose its anchor.
2. Every window with such an anchor is hashed and Spark finds the smallest document of each.  A block states a window
   once, whatever the number of its documents that hold it, so a passage that all documents share gives a row for
   each block.
3. Windows whose sequence also starts in a smaller document come back to their block; they are merged into
   maximal intervals, which are cut out.

A window has two polynomial hashes modulo the prime 2^61 - 1, over the two halves of its words' 128-bit hashes and of
two bases; bases and the words' seed are drawn anew for each call, so no text can be made to collide.  Two given windows
of 50 words that differ agree in both with a chance below 10^-33, any two of 10^14 windows below 10^-5.

Defined results: a null text has no words; texts shorter than a window stay whole; rows of one ``doc_id`` are one
document when windows are judged and each give their own result, so repeated rows don't remove each other; rows of one
``doc_id`` may be in several blocks; a null ``doc_id`` counts as larger than all others; further columns are kept,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.tables import fresh

WINDOW_WORDS = 50
#: Bytes of text in a block, which one task holds at once.
BLOCK_BYTES = 4 << 20
_WORDS_AT_ONCE = 1 << 15
_LAST_ID = (1 << 63) - 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PRIME = (1 << 61) - 1


@dataclass(frozen=True)
class Hashing:
    """What the hashes depend on; drawn by the driver and the same in all tasks of a call."""

    seed: int = field(default_factory=lambda: secrets.randbits(60))
    bases: tuple[int, int] = field(default_factory=lambda: (secrets.randbelow(_PRIME - (1 << 32)) + (1 << 32), secrets.randbelow(_PRIME - (1 << 32)) + (1 << 32)))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, factor: int) -> np.ndarray:
    """``a * factor`` modulo the prime; halves of 32 bits keep every product below 2^64."""
    high, low = a >> np.uint64(32), a & np.uint64(0xFFFFFFFF)
    f_high, f_low = np.uint64(factor >> 32), np.uint64(factor & 0xFFFFFFFF)
    middle, least = high * f_low + low * f_high, low * f_low
    total = (high * f_high << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _reduced(total + (least & np.uint64(_PRIME)) + (least >> np.uint64(61)))


def polynomial(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo the prime, of all runs of ``n`` of ``values``, by doubling the runs' length."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    out = np.empty(len(values) - n + 1, np.uint64)
    for at in range(0, len(out), _WORDS_AT_ONCE):
        part = values[at : at + _WORDS_AT_ONCE + n - 1]
        power, run, done, found = 1, part, 0, None
        while True:
            if n & power:
                found = run if found is None else _reduced(_times(found[: len(run) - done], pow(base, power, _PRIME)) + run[done:])
                done += power
            if done == n:
                break
            run = _reduced(_times(run[:-power], pow(base, power, _PRIME)) + run[power:])
            power *= 2
        out[at : at + _WORDS_AT_ONCE] = found[: len(part) - n + 1]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts, their hashes, and the windows that lie within one text."""

    def __init__(self, texts: list[str | None], size: int, hashing: Hashing):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b" ".join([*raw, b""])
        data = np.frombuffer(self.raw, dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        inner = ~_BLANK[data]
        edge = np.diff(np.concatenate([[0], inner.astype(np.int8), [0]]))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: First word of each text, and past the last.
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.counts = np.diff(self.bounds)
        self.size, self.hashing = size, hashing
        self.first, self.second = self._word_hashes(data[inner])
        #: First words of the windows, and the text of each.
        per_text = np.maximum(self.counts - size + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.at = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text) + self.bounds[:-1][self.text]

    def _word_hashes(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each word; only different words are hashed."""
        import xxhash

        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        seed = self.hashing.seed
        digests = b"".join([xxhash.xxh3_128_digest(w, seed) for w in words.dictionary.to_pylist()])
        halves = _reduced(np.frombuffer(digests, np.uint64).reshape(-1, 2))
        codes = words.indices.to_numpy()
        return halves[codes, 0], halves[codes, 1]

    def anchors(self) -> np.ndarray:
        """For each window the least hash of its sub-windows of half its length."""
        half = max(1, self.size // 2)
        if not len(self.at):
            return np.empty(0, np.uint64)
        least = _mix(polynomial(self.first, half, self.hashing.bases[0]))
        width, wanted = 1, self.size - half + 1
        while 2 * width <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        return np.minimum(least[self.at], least[self.at + wanted - width])

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[which]
        return tuple(polynomial(values, self.size, base)[at] for values, base in zip((self.first, self.second), self.hashing.bases))


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(_LAST_ID).to_numpy()


def _collapsed(keys: list[np.ndarray], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different keys with the smallest and largest document of each."""
    order = np.lexsort((docs, *reversed(keys)))
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(docs) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(docs)]])[: len(first)] - 1
    return [k[first] for k in keys], docs[first], docs[last]


def cut_repeats(docs: DataFrame, into: str = "cut", window_words: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, joined: bool = True) -> DataFrame:
    """``docs`` with a column ``into``: struct of ``n_words``, ``n_removed``, ``runs`` (removed words, half-open), ``kept``.

    ``kept`` are the kept words joined by one space or, with ``joined`` false, the text without the removed spans.
    """
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    n_blocks, block, hashing = block_count(docs, block_bytes), fresh("block", [*docs.columns, "anchor", "h1", "h2", "low", "high", "least"]), Hashing()
    # the place in the input deals out rows that repeat
    blocks = docs.withColumn(block, F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))

    rows = blocks.groupBy(block).applyInArrow(_state_anchors(block, window_words, hashing), f"{block} int, anchor long, low long, high long")
    by_anchor = Window.partitionBy("anchor")
    repeated = rows.withColumn("least", F.min("low").over(by_anchor)).withColumn("most", F.max("high").over(by_anchor)).where("least < most").select(block, "anchor")

    rows = blocks.groupBy(block).cogroup(repeated.groupBy(block)).applyInArrow(_state_windows(block, window_words, hashing), f"{block} int, h1 long, h2 long, low long, high long")
    by_window = Window.partitionBy("h1", "h2")
    earlier = rows.withColumn("least", F.min("low").over(by_window)).where("high > least").select(block, "h1", "h2", "least")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    result = f"{schema}, `{into}` struct<n_words: bigint, n_removed: bigint, runs: array<array<bigint>>, kept: string>"
    return blocks.groupBy(block).cogroup(earlier.groupBy(block)).applyInArrow(_cut(docs.columns, into, window_words, hashing, joined), result)


def _state_anchors(block: str, size: int, hashing: Hashing) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        words = Words(table.column("text").to_pylist(), size, hashing)
        (anchor,), low, high = _collapsed([words.anchors().view(np.int64)], _ids(table)[words.text])
        own = np.full(len(anchor), table.column(block)[0].as_py(), dtype=np.int32)
        return pa.table({block: own, "anchor": anchor, "low": low, "high": high})

    return run


def _state_windows(block: str, size: int, hashing: Hashing) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, repeated: pa.Table) -> pa.Table:
        wanted = np.sort(repeated.column("anchor").to_numpy()) if repeated.num_rows else np.empty(0, np.int64)
        if not table.num_rows or not len(wanted):
            return pa.table({block: pa.array([], pa.int32())} | {c: pa.array([], pa.int64()) for c in ("h1", "h2", "low", "high")})
        words = Words(table.column("text").to_pylist(), size, hashing)
        which = np.flatnonzero(_among(words.anchors().view(np.int64), wanted))
        h1, h2 = words.window_hashes(which)
        (h1, h2), low, high = _collapsed([h1.view(np.int64), h2.view(np.int64)], _ids(table)[words.text[which]])
        own = np.full(len(h1), table.column(block)[0].as_py(), dtype=np.int32)
        return pa.table({block: own, "h1": h1, "h2": h2, "low": low, "high": high})

    return run


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values if len(wanted) else np.zeros(len(values), bool)


def _cut(columns: list[str], into: str, size: int, hashing: Hashing, joined: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())])

    def run(table: pa.Table, earlier: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        words = Words(texts, size, hashing)
        covered = np.zeros(len(words.start) + 1, dtype=np.int64)
        if earlier.num_rows and len(words.at):
            key = {(a, b): c for a, b, c in zip(*(earlier.column(n).to_pylist() for n in ("h1", "h2", "least")))}
            h1, h2 = words.window_hashes(np.arange(len(words.at)))
            h1, h2 = h1.view(np.int64), h2.view(np.int64)
            which = np.flatnonzero(_among(h1, np.sort(earlier.column("h1").to_numpy())))
            least = np.array([key.get(k, _LAST_ID) for k in zip(h1[which].tolist(), h2[which].tolist())], dtype=np.int64)
            which = which[least < _ids(table)[words.text[which]]]
            np.add.at(covered, words.at[which], 1)
            np.add.at(covered, words.at[which] + size, -1)
        gone = np.cumsum(covered)[:-1] > 0
        out = []
        for k, text in enumerate(texts):
            a, b = int(words.bounds[k]), int(words.bounds[k + 1])
            out.append(_one(words, a, b, gone[a:b], text, joined))
        return pa.table([table.column(c) for c in columns] + [pa.array(out, type=kind)], names=[*columns, into])

    return run


def _one(words: Words, a: int, b: int, gone: np.ndarray, text: str | None, joined: bool) -> dict:
    n_removed = int(gone.sum())
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    if joined:
        # blanks between words become one space; runs of kept words are read together
        kept = b" ".join(x for first, end in _rest(runs, b - a) for x in words.raw[words.start[a + first] : words.end[a + end - 1]].split())
    elif not n_removed:
        return {"n_words": b - a, "n_removed": 0, "runs": [], "kept": text}
    else:
        kept = b" ".join(words.raw[words.start[a + first] : words.end[a + end - 1]] for first, end in _rest(runs, b - a))
    return {"n_words": b - a, "n_removed": n_removed, "runs": runs.tolist(), "kept": kept.decode("utf-8", "surrogatepass")}


def _rest(runs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The half-open runs between ``runs`` in ``range(n)``."""
    edges = [0, *runs.ravel().tolist(), n]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; documents that consist of them alone go."""
    into = fresh("cut", docs.columns)
    cut = cut_repeats(docs, into, joined=False, **options)
    some = (F.col(into)["n_removed"] == 0) | (F.col(into)["n_removed"] < F.col(into)["n_words"])
    columns = [F.col(into)["kept"].alias(c) if c == "text" else F.length(F.col(into)["kept"]).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cut.where(some).select(*columns)


def verdicts(cut: DataFrame, into: str = "cut") -> DataFrame:
    """The digest of :func:`cut_repeats`."""
    c = F.col(into)
    return cut.select("doc_id", c["n_words"].alias("n_words"), c["n_removed"].alias("n_removed"), F.sha2(c["kept"].cast("binary"), 256).alias("kept_sha256"))
