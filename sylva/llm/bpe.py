"""Byte-level BPE: overlapping chunk encoding and raw-byte decoding.

Every text is cut into chunks of ``chunk_chars`` that overlap by ``overlap_chars``, each pre-tokenised on its own.  A chunk
starts at an arbitrary place, so its first boundaries may be wrong, as may the last ones of the chunk before; but
matches of the pattern depend on what follows them only, so from the first boundary that both chunks agree on they
agree for good.  That seam cuts the text into pieces of whole pre-tokens, which are encoded separately.  Where two
chunks share no boundary in their overlap (a run of letters longer than it), the chunk before grows by more and more
chunks until it shares one with the next.

The chunks of a text of up to ``task_chars`` are worked on one after the other where the text is read.  Those of a longer
one are dealt over the cluster, and only their boundaries and ids meet; if some overlap has no seam, such a text is
gathered and cut in one task like a shorter one.

Defined results: a null text is an empty one and has no ids; repeated rows each give their own result; a null
``doc_id`` is a value like any other; further columns of the input are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.tables import scratch_path

#: Characters of a chunk, and by how many it overlaps the next one.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 10, 1 << 7
#: Characters of the longest text whose chunks are worked on in one task.
TASK_CHARS = 1 << 16
#: No alternative of the pattern looks further ahead than this many characters past its start.
LOOKAHEAD = 4
#: Texts encoded at once inside a task, in characters: bounds the ids held in Python.
_BLOCK_CHARS = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """A rank file (base64 token, blank, rank) and the pattern of its pre-tokens."""

    path: str
    pattern: str

    @functools.cached_property
    def _key(self) -> tuple[str, str]:
        return self.path, self.pattern


@functools.lru_cache(maxsize=4)
def _load(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tiktoken.Encoding("rank-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table, [str(i) for i in range(len(table))]


def encode_text(text: str, vocabulary: Vocabulary) -> list[int]:
    return _load(*vocabulary._key)[0].encode_ordinary(text)


def decode_ids(ids, vocabulary: Vocabulary) -> bytes:
    """The raw bytes of the ids, one after the other; they need not be valid UTF-8 on their own."""
    table = _load(*vocabulary._key)[1]
    return b"".join(map(table.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def _ends(text: str, pattern: str) -> np.ndarray:
    """Ends of all pre-tokens of ``text``."""
    found = _compiled(pattern)
    if not found.groups:
        ends = np.cumsum(np.fromiter(map(len, found.findall(text)), dtype=np.int64))
        if (int(ends[-1]) if len(ends) else 0) == len(text):  # else the pattern leaves gaps
            return ends
    return np.array([m.end() for m in found.finditer(text)], dtype=np.int64)


def _between(text: str, ends: np.ndarray, first: int, past: int) -> list[int]:
    """Those boundaries from ``first`` on and before ``past`` that can be seams: the character before is no white space.

    Cut behind white space, the left piece would lose the character that its look-ahead needs.
    """
    a, b = np.searchsorted(ends, (first, past))
    return [e for e in ends[a:b].tolist() if not text[e - 1].isspace()]


def shared_boundaries(chunk: str, pattern: str, chunk_chars: int, overlap_chars: int) -> tuple[list[int], list[int]]:
    """The boundaries that a chunk shares out: those before the end of its first overlap, and those in the last one.

    The latter count from the start of the next chunk.
    """
    ends = _ends(chunk, pattern)
    return _between(chunk, ends, 0, overlap_chars), [e - chunk_chars for e in _between(chunk, ends, chunk_chars, len(chunk) - LOOKAHEAD + 1)]


def seams(text: str, pattern: str, chunk_chars: int, overlap_chars: int) -> list[int]:
    """Where ``text`` can be cut: one place for each two chunks that meet, but for those that had to grow together."""
    n = -(-len(text) // chunk_chars)
    if n < 2:
        return []
    of = [shared_boundaries(text[k : k + chunk_chars + overlap_chars], pattern, chunk_chars, overlap_chars) for k in range(0, len(text), chunk_chars)]
    found, start, tail, at, width = [], 0, of[0][1], 1, 1
    while at < n:
        shared = set(tail).intersection(of[at][0])
        if shared:
            start = at * chunk_chars + min(shared)
            found.append(start)
            tail, at, width = of[at][1], at + 1, 1
        else:  # the chunk grows from its first sure boundary, by twice as many chunks each time
            at, width = at + width, 2 * width
            if at < n:
                grown = text[start : at * chunk_chars + overlap_chars]
                tail = shared_boundaries(grown, pattern, at * chunk_chars - start, overlap_chars)[1]
    return found


def encode(docs: DataFrame, vocabulary: Vocabulary, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """``doc_id``, ``row`` long, ``piece`` int, ``n_pieces`` int, ``ids`` array<int>.

    A text's ids are those of its pieces in order; ``row`` tells texts apart.
    """
    texts, dealt = _parts(docs, vocabulary, chunk_chars, overlap_chars, task_chars)
    schema = "doc_id long, row long, piece int, n_pieces int, ids array<int>"
    cut = lambda batches: _cut_here(batches, vocabulary.pattern, chunk_chars, overlap_chars)
    return texts.mapInArrow(lambda batches: _encoded(cut(batches), vocabulary), schema).unionByName(dealt.mapInArrow(lambda batches: _encoded(batches, vocabulary), schema))


def encoded_digests(docs: DataFrame, vocabulary: Vocabulary, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """:func:`digests` of all texts.

    A text whose pieces are in one task is cut, encoded, decoded and hashed in one go; pieces that were dealt are
    encoded wherever they are and only their ids meet in one task.
    """
    texts, dealt = _parts(docs, vocabulary, chunk_chars, overlap_chars, task_chars)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    packed = dealt.mapInArrow(lambda batches: _packed(_encoded(batches, vocabulary), vocabulary), "doc_id long, row long, piece int, n_pieces int, ids binary")
    met = together(packed).mapInArrow(lambda batches: _digested(_unpacked(batches, vocabulary), vocabulary), schema)
    cut = lambda batches: _cut_here(batches, vocabulary.pattern, chunk_chars, overlap_chars)
    return texts.mapInArrow(lambda batches: _digested(_encoded(cut(batches), vocabulary), vocabulary), schema).unionByName(met)


def _parts(docs: DataFrame, vocabulary: Vocabulary, chunk_chars: int, overlap_chars: int, task_chars: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``row``, ``text``: the texts that a task cuts; and the pieces of those whose chunks were dealt."""
    if overlap_chars <= LOOKAHEAD or chunk_chars <= overlap_chars:
        raise ValueError("a chunk must be longer than the overlap, and that longer than the look-ahead")
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text)
    longer = F.length("text") > max(task_chars, chunk_chars)
    pieces, unseamed = _stitched(rows.where(longer), vocabulary.pattern, chunk_chars, overlap_chars)
    # dealt texts keep their numbers, all others have negative ones
    here = rows.where(~longer).withColumn("row", -1 - F.col("row"))
    return here.unionByName(unseamed), pieces


def _cut_here(batches: Iterator[pa.RecordBatch], pattern: str, chunk_chars: int, overlap_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_blocks(batch, "text", _BLOCK_CHARS):
            doc_ids, rows, numbers, counts, texts = [], [], [], [], []
            for doc_id, row, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                cuts = [0, *seams(text, pattern, chunk_chars, overlap_chars), len(text)]
                n = len(cuts) - 1
                doc_ids += [doc_id] * n
                rows += [row] * n
                numbers += range(n)
                counts += [n] * n
                texts += [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            kinds = (part.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip((doc_ids, rows, numbers, counts, texts), kinds)], names=[*_PIECE, "text"])


def _stitched(long: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of each row's text, cut at the seams of its chunks, and the texts that lack some seam.

    Chunks are written to the folder that the cluster shares.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            for doc_id, row, n, text in zip(*(column.to_pylist() for column in batch.columns)):
                for at in range(0, n, 64):
                    places = [k * chunk_chars for k in range(at, min(n, at + 64))]
                    parts = zip(*((doc_id, row, at + k, n, text[start : start + chunk_chars + overlap_chars]) for k, start in enumerate(places)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(parts, kinds)], names=["doc_id", "row", "piece", "n_pieces", "chunk"])

    spark, schema = long.sparkSession, "doc_id long, row long, piece int, n_pieces int, chunk string"
    path = scratch_path(spark, "chunks")
    keyed = long.select("doc_id", "row", F.ceil(F.length("text") / chunk_chars).cast("int").alias("n_pieces"), "text")
    keyed.mapInArrow(cut_up, schema).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(schema).parquet(path)

    kind, name = (pa.int16(), "smallint") if overlap_chars < 1 << 15 else (pa.int32(), "int")

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for k, n, chunk in zip(*(batch.column(c).to_pylist() for c in ("piece", "n_pieces", "chunk"))):
                head, tail = shared_boundaries(chunk, pattern, chunk_chars, overlap_chars)
                heads.append(head if k else [])
                tails.append(tail if k < n - 1 else [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("piece"), batch.column("n_pieces"), *(pa.array(x, pa.list_(kind)) for x in (heads, tails))], names=["row", "piece", "n_pieces", "head", "tail"])

    found = chunks.select("row", "piece", "n_pieces", "chunk").mapInArrow(pre_tokenise, f"row long, piece int, n_pieces int, head array<{name}>, tail array<{name}>")
    sides = found.select("row", F.explode(F.array(F.struct("piece", F.lit("head").alias("side"), F.col("head").alias("at")), F.struct((F.col("piece") + 1).alias("piece"), F.lit("tail").alias("side"), F.col("tail").alias("at")))).alias("s"), "n_pieces")
    sides = sides.where((F.col("s.piece") > 0) & (F.col("s.piece") < F.col("n_pieces"))).select("row", "s.*")
    side = lambda which: F.max(F.when(F.col("side") == which, F.col("at")))
    seams = sides.groupBy("row", "piece").agg(F.array_min(F.array_intersect(side("head"), side("tail"))).cast("int").alias("seam"))
    # written first: what follows reads it twice
    seams.write.parquet(f"{path}-seams")
    seams = spark.read.schema("row long, piece int, seam int").parquet(f"{path}-seams")
    # where a chunk's piece begins and ends: small rows, which meet the chunks once
    ends = F.explode(F.array(F.struct("piece", F.col("seam").alias("from"), F.lit(None).cast("int").alias("until")), F.struct((F.col("piece") - 1).alias("piece"), F.lit(None).cast("int").alias("from"), F.col("seam").alias("until"))))
    cuts = seams.select("row", ends.alias("e")).groupBy("row", "e.piece").agg(F.max("e.from").alias("from"), F.max("e.until").alias("until"))
    lost = seams.where(F.col("seam").isNull()).select("row", F.lit(True).alias("lost")).distinct()
    # of a written table Spark knows the size when it plans the join, so that chunks aren't shuffled to meet a small one
    cuts = cuts.join(lost, "row", "left")
    cuts.write.parquet(f"{path}-cuts")
    met = chunks.join(spark.read.schema(cuts.schema).parquet(f"{path}-cuts"), ["row", "piece"])

    first = F.coalesce(F.col("from"), F.lit(0))
    size = F.coalesce(F.col("until") + chunk_chars, F.length("chunk")) - first
    cut = met.where("lost is null").select("doc_id", "row", "piece", "n_pieces", F.col("chunk").substr(first + 1, size).alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("piece", F.left("chunk", F.lit(chunk_chars)).alias("part"))))
    whole = met.where("lost").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_join(parts["part"], "").alias("text"))
    return cut, whole.select("doc_id", "row", "text")


_PIECE = ("doc_id", "row", "piece", "n_pieces")


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    encoding = _load(*vocabulary._key)[0]
    for batch in batches:
        for part in text_blocks(batch, "text", _BLOCK_CHARS):
            ids = [encoding.encode_ordinary(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _PIECE), int_lists(ids)], names=[*_PIECE, "ids"])


def _width(vocabulary: Vocabulary) -> str:
    return "<u2" if len(_load(*vocabulary._key)[1]) <= 1 << 16 else "<u4"


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Pieces with their ids in few bytes, for the way to the task where a text's pieces meet: all low bytes, then the higher ones."""
    width = int(_width(vocabulary)[-1])
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy().astype(_width(vocabulary)), ids.offsets.to_numpy()
        small = [zlib.compress(flat[a:b].view(np.uint8).reshape(-1, width).T.tobytes(), 1) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECE), pa.array(small, pa.binary())], names=[*_PIECE, "ids"])


def _unpacked(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    width = int(_width(vocabulary)[-1])
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            planes = [np.frombuffer(zlib.decompress(x), np.uint8).reshape(width, -1) for x in part.column("ids").to_pylist()]
            ids = [np.ascontiguousarray(p.T).view(_width(vocabulary))[:, 0] for p in planes]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _PIECE), int_lists(ids)], names=[*_PIECE, "ids"])


def text_blocks(batch: pa.RecordBatch, column: str, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``most_chars`` bytes of text; a longer text stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(sizes[at : at + 4096])
        n = max(1, int(np.searchsorted(total, most_chars, side="right")))
        yield batch.slice(at, n)
        at += n


def int_lists(lists: list) -> pa.ListArray:
    """Lists of ints as an Arrow column, without an object for each element."""
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate([np.asarray(x, dtype=np.int32) for x in lists]) if lists else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def decode(pieces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``bytes`` binary: the raw bytes of a piece's ids."""
    schema = "doc_id long, row long, piece int, n_pieces int, ids array<int>, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            decoded = [decode_ids(x, vocabulary) for x in _each(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, type=pa.binary())], names=[*batch.schema.names, "bytes"])

    return pieces.select("doc_id", "row", "piece", "n_pieces", "ids").mapInArrow(run, schema)


def _each(lists: pa.ListArray) -> Iterator[list[int]]:
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b].tolist()


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: one row for each text, its ids decoded again.

    The pieces of a text must follow one another within a partition (:func:`together`); they are hashed as they
    stream by, a piece at a time.
    """
    return encoded.select(*_PIECE, "ids").mapInArrow(lambda batches: _digested(batches, vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digested(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    _, table, names = _load(*vocabulary._key)
    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        head = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "n_pieces")))
        for (doc_id, piece, n_pieces), ids in zip(head, _each(batch.column("ids"))):
            of_ids.update(("," * bool(n and ids) + ",".join(map(names.__getitem__, ids))).encode())
            of_bytes.update(b"".join(map(table.__getitem__, ids)))
            n += len(ids)
            if piece == n_pieces - 1:
                out.append((doc_id, n, of_ids.hexdigest(), of_bytes.hexdigest()))
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def together(pieces: DataFrame) -> DataFrame:
    """Deals whole texts to the partitions, each with its pieces in order."""
    return pieces.repartition("row").sortWithinPartitions("row", "piece")
