"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark.

Texts are normalised byte by byte, so offsets survive: A-Z is lower-cased, every other ASCII character than a
letter or digit becomes a blank, all else stands.  The words of an item are cut into windows; all windows
make one automaton, which is sent to the tasks, and each text is scanned once.  Of a benchmark of more than
``block_bytes`` of windows a task holds one automaton at a time: it keeps a bounded number of texts and scans them for
one block of windows after the other, in the same pass over the documents.

Defined results: a null text has no words; items without words are never found, and the
windows of an item with a null id hit without an item; an item id that occurs twice is one item; repeated rows each give their own
result; further columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.tables import checkpoint_dir, fresh

WINDOW_WORDS = 10
#: Most bytes of windows in one automaton (some 50 bytes of memory for each), and of texts that wait for the next one.
BLOCK_BYTES, TEXT_BYTES = 4 << 20, 16 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW_WORDS) -> set[bytes]:
    words = normalise(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Automaton:
    """Windows and the items they occur in; ``scan`` finds every occurrence in a text, word-aligned."""

    def __init__(self, owners: list[tuple[bytes, list[int]]]):
        import ahocorasick

        self.found = [(w.count(b" ") + 1, ids) for w, ids in owners]
        self.automaton = ahocorasick.Automaton()
        for k, (w, _) in enumerate(owners):
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Hit runs of words as (first, past the last) and the items found."""
        if self.empty or not words:
            return np.empty((0, 2), dtype=np.int64), set()
        line = b" " + b" ".join(words) + b" "
        ends, which = [], []
        for end, k in self.automaton.iter(line.decode("latin-1")):
            ends.append(end)
            which.append(k)
        if not ends:
            return np.empty((0, 2), dtype=np.int64), set()
        blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
        last = np.searchsorted(blanks, ends)
        runs = np.stack([last - np.array([self.found[k][0] for k in which]), last], axis=1)
        return merge_runs(runs), {i for k in set(which) for i in self.found[k][1]}


def merge_runs(runs: np.ndarray) -> np.ndarray:
    """Union of half-open runs, in order, touching ones joined."""
    if len(runs) < 2:
        return runs
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    reach = np.maximum.accumulate(runs[:, 1])
    first = np.concatenate([[True], runs[1:, 0] > reach[:-1]])
    return np.stack([runs[first, 0], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(runs) - 1]])]], axis=1)


def original_spans(text: str, runs: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets in ``text`` of runs of its normalised words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    is_word = np.frombuffer(_TABLE, dtype=np.uint8)[raw] != 32
    edge = np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


@functools.lru_cache(maxsize=1)
def _automaton(owners: bytes) -> Automaton:
    return Automaton(pickle.loads(owners))


def item_windows(benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``window`` binary, ``items`` array<long>: every different window with the ids of its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = list(windows(text, window_words))
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(found), type=pa.int64()), pa.array(found, type=pa.binary())], names=["item_id", "window"])

    each = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, window binary")
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


#: What a scan tells of a text: its words, the hit runs of words (half-open), the same in code points, the items.
FINDING = "struct<n_words: bigint, runs: array<array<bigint>>, spans: array<array<bigint>>, items: array<bigint>>"
_FINDING = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])


def scan(docs: DataFrame, benchmark: DataFrame, into: str = "finding", window_words: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``into`` of :data:`FINDING`; no row is shuffled."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    spark = docs.sparkSession
    checkpoint_dir(spark)
    owners = item_windows(benchmark, window_words).checkpoint()
    size = owners.select(F.sum(F.octet_length("window") + 2).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(size) // block_bytes))
    sent = []
    for k in range(n_blocks):
        block = owners.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k).collect()
        sent.append(spark.sparkContext.broadcast(pickle.dumps(sorted((bytes(r["window"]), list(r["items"])) for r in block))))
    result = docs.withColumn(into, F.lit(None).cast(FINDING))
    return result.mapInArrow(_scanner(sent, into), result.schema)


def _scanner(sent: list, into: str):
    def found(texts: list[str | None]) -> list[dict]:
        runs, items, n_words = [[] for _ in texts], [set() for _ in texts], [0] * len(texts)
        for block in sent:
            automaton = _automaton(block.value)
            for k, text in enumerate(texts):
                words = normalise(text)
                n_words[k] = len(words)
                own, ids = automaton.scan(words)
                if len(own):
                    runs[k].append(own)
                    items[k] |= ids
        merged = [merge_runs(np.concatenate(r)) if r else np.empty((0, 2), np.int64) for r in runs]
        return [{"n_words": n, "runs": r.tolist(), "spans": original_spans(t, r) if len(r) else [], "items": sorted(i)} for n, r, t, i in zip(n_words, merged, texts, items)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            # with one block nothing is gained by waiting
            if size >= TEXT_BYTES or len(sent) == 1:
                yield from scanned(held)
                held, size = [], 0
        yield from scanned(held)

    def scanned(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = found([t for batch in held for t in batch.column("text").to_pylist()]), 0
        for batch in held:
            own = pa.array(out[at : at + batch.num_rows], type=_FINDING)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([own if c == into else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return run


def verdicts(scanned: DataFrame, finding: str = "finding") -> DataFrame:
    """The digest of :func:`scan`: counts, the items' checksum, and whether a document is contaminated."""
    f = F.col(finding)
    hit = F.aggregate(f["runs"], F.lit(0).cast("long"), lambda n, r: n + F.get(r, F.lit(1)) - F.get(r, F.lit(0)))
    names = F.array_sort(F.transform(f["items"], lambda i: i.cast("string")))
    checksum = F.sha2(F.array_join(names, ",").cast("binary"), 256)
    return scanned.select("doc_id", f["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), checksum.alias("items_sha256"), (F.size(f["runs"]) > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their columns."""
    into = fresh("finding", docs.columns)
    return scan(docs, benchmark, into, **options).where(F.size(F.col(into)["runs"]) == 0).select(*docs.columns)
