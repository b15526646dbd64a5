"""Token ids as Parquet list columns that can be read in part.

The files hold documents in ascending ``doc_id`` order, one range of them each.  Ids are dictionary-encoded or
delta-encoded, the plain columns ``doc_id`` and ``n_tokens`` stand beside the list, row groups and pages have a
set size, and pages are indexed, so that a reader of the metadata never touches the ids and a reader of a few
documents skips the other pages.

Defined results: a null text is an empty one (its ids are the end id alone); the spelling of a special token in a text gets that
token's id, as the library has it by default; rows of one ``doc_id`` are ordered
by their text's hash and each kept; a null ``doc_id`` comes first; further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.bpe import text_blocks

#: Different words whose ids a task remembers; the oldest go beyond that.
WORDS_KEPT = 400_000
_BLOCK_CHARS = 1 << 22


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes many texts at once, each different word of them a single time.

    No pre-token runs on from a character other than white space to white space, nor from an ASCII letter or digit to a
    comma or full stop, so texts can be cut at those places and the ids of the words are those of the text; no special token
    holds such a place, and the library cuts texts at special tokens itself.  Arrow
    finds the different words and puts their ids in the words' places.  Ids of words seen before are remembered; new
    words are encoded many at a time in one string and told apart by the bytes of their tokens.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        for token in self.tokenizer.get_added_tokens_decoder().values():
            raw = np.frombuffer(token.content.encode(), np.uint8)
            if token.lstrip or token.rstrip or token.single_word or len(word_starts(raw, np.array([0, len(raw)]))) > 1:
                raise ValueError(f"texts can't be cut into words around the token {token.content!r}")
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(tokens.values()) + 1, dtype=np.int64)
        for token, i in tokens.items():
            self.n_bytes[i] = len(token)  # a byte-level token is spelt with one character for each byte
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> pa.ListArray:
        """The ids of each text as int32, ``end_id`` last if there is one."""
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        first = word_starts(data, ends)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        different = coded.dictionary.to_pylist()
        self._learn(different)
        own = [self.known[w] for w in different]
        if end_id is not None:
            own.append(np.int32(end_id).tobytes())
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), np.int32)))
        codes, bounds = coded.indices.to_numpy(), np.searchsorted(first, ends)
        if end_id is not None:
            codes = np.insert(codes, bounds[1:], len(own) - 1)
            bounds = bounds + np.arange(len(bounds))
        placed = lists.take(pa.array(codes))
        at = np.frombuffer(placed.buffers()[1], np.int32, len(placed) + 1, 4 * placed.offset)
        return pa.ListArray.from_arrays(pa.array(at[bounds] - at[0]), placed.flatten())

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        if older:
            known.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in known]
        # words that start with white space and don't end with it keep their ids when they are joined
        joined = [w for w in new if w[0] in b" \n" and (32 < w[-1] < 127 or not w.decode()[-1].isspace())]
        for at in range(0, len(joined), 500):
            self._learn_joined(joined[at : at + 500])
        alone = [w for w in new if w not in known]
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)):
            known[w] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _learn_joined(self, words: list[bytes]) -> None:
        ids = np.asarray(self.tokenizer.encode_batch_fast([b"".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(list(map(len, words)))) + 1
        raw, ends = ids.tobytes(), (cuts * 4).tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends))))


_BLANK, _ALNUM, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP[[44, 46]] = True


def word_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where UTF-8 texts that end at ``ends[1:]`` can be cut so that the ids of the parts are those of the texts."""
    blank, n = _BLANK[data], len(data)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (blank[1:] & ~blank[:-1]) | (_STOP[data[1:]] & _ALNUM[data[:-1]])
    # behind a letter of several bytes, if it isn't white space
    at = np.flatnonzero(cut[:n])
    at = at[data[at - 1] >= 128]
    if len(at):
        one, two, three = data[at - 1], data[at - 2], data[np.maximum(at - 3, 0)]
        general = (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
        wide = ((three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80)) & (one == 0x80)
        cut[at[general | wide | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))]] = False
    cut[ends[ends < n]] = True
    return np.flatnonzero(cut[:n])


@functools.lru_cache(maxsize=1)
def _word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which serves several tasks."""
    return WordEncoder(path)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id``, ``n_tokens`` long, ``ids`` array<int> with ``end_id`` last; keeps partitions and their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_encoder(tokenizer_path)
        for batch in batches:
            for part in text_blocks(batch, "text", _BLOCK_CHARS):
                ids = encoder.encode(part.column("text"), end_id)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids.value_lengths().cast(pa.int64()), ids], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, files: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 2_000, ids_encoding: str = "dictionary") -> None:
    """Writes the ids of every text in ascending ``doc_id`` order; the names of the files sort like their ranges.

    Texts are dealt by ranges of ``doc_id``, their hash and their place in the input before they are encoded: they are
    smaller than their ids, and an id that very many rows share is spread over ranges too.
    ``ids_encoding`` is ``dictionary`` or ``delta``; ``files`` defaults to Spark's number of shuffle partitions.
    """
    if ids_encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding of ids: {ids_encoding}")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.col("hash"), F.col("row")]
    ordered = (texts.repartitionByRange(files, *order) if files else texts.repartitionByRange(*order)).sortWithinPartitions(*order)
    writer = encode(ordered, tokenizer_path, end_id).write.mode("errorifexists")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": str(ids_encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.page.write-checksum.enabled": "true",
        "parquet.dictionary.page.size": str(1 << 20),
    }
    writer.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``; Spark reads the columns and pages that are asked for."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)


def _placed(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The columns, and ``file`` and ``at``, a row's place in it."""
    rows = spark.read.schema(columns).parquet(path)
    return rows.select(*rows.columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def file_order(file: Column) -> list[Column]:
    """The order in which files were written: by the numbers in their names, which needn't have equally many digits."""
    number = lambda pattern: F.coalesce(F.regexp_extract(file, pattern, 1).try_cast("long"), F.lit(0).cast("long"))
    return [number(r"^part-(\d+)"), number(r"-c(\d+)\b"), file]


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` (``file``, ``at``, ``n_tokens``, ...) with ``start``: ids of all documents before it.

    Sums run within each file, which holds a range of documents; files are then offset by the total of the files before them,
    of which there is one row each, from a read of ``n_tokens`` alone.
    """
    totals = _placed(spark, path, "n_tokens long").groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy(*file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return running.join(offsets, "file").select(*rows.columns, (F.col("inside") + F.col("offset")).alias("start"))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``file``, ``at``, ``start``; reads ``doc_id`` and ``n_tokens`` only."""
    return with_starts(spark, path, _placed(spark, path, "doc_id long, n_tokens long"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``file``, ``at``, ``n_tokens``, ``ids_crc32``: crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = memoryview(ids.values.to_numpy().astype("<u4")).cast("B"), 4 * ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            sizes = (np.diff(ends) // 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("at"), pa.array(sizes), pa.array(crc, type=pa.int64())], names=["doc_id", "file", "at", "n_tokens", "ids_crc32"])

    rows = _placed(spark, path, "doc_id long, ids array<int>")
    return rows.mapInArrow(run, "doc_id long, file string, at long, n_tokens long, ids_crc32 long")
