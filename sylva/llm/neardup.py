"""SimHash near-duplicates by Golay fuzzy hashing.

A text's 64-bit fingerprint is cut into two halves; of two fingerprints that differ in at most 3 bits one half differs
in at most one bit (pigeonhole).  A half is keyed by the Golay codewords near its low 23 bits together with its
exact upper 9 bits, and by its exact low 23 bits: the one error is in either part, so the halves share a key.  The other
half has 3 errors at most, so one of its 4 bytes has none: each key is joined by each of these bytes.  Distinct
fingerprints meet by key, are compared, and linked; the links' connected components are the groups.  Within a key
only a spanning forest of the links is given, found by comparing with pivots, so a group of copies gives links in
proportion to its size; keys of very many fingerprints are dealt out in cells, every pair of which meets in one.

The pipeline's stage (:func:`keep_first`) groups the SimHashes of the texts' different 5-word shingles by the same Golay
keys.  A SimHash can't tell a similarity of 0.8 from one of 0.7, so every link is checked on the whole shingle sets, and
texts that the groups part are met once more by MinHash keys of the same shingles.

A node's name begins with the smallest ``doc_id`` of its texts, so that the smallest name of a component, its root,
tells the group's id without another join.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a null ``doc_id`` is never
a group's id unless all its documents have none; rows of one ``doc_id`` are kept apart by their text, and rows
that repeat each give their own result, though :func:`keep_first` leaves one of them; further columns are ignored,
or kept by :func:`keep_first` whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm import golay, simhash
from sylva.llm.components import components
from sylva.llm.tables import checkpoint_dir, fresh, spread_join

#: The most differing bits for which two halves are sure to share a key.
RADIUS = 3
#: Fingerprints of one key that are compared in one task; more are dealt out in cells.
CELL_ROWS = 16_384
_ALL_PAIRS = 8
#: Differing bits up to which :func:`print_groups` takes prints that share a key; sharing one is sure up to ``RADIUS``.
GROUP_BITS = 12
#: MinHash keys of a text and values of each: two texts of similarity 0.8 share none with a chance of 3 in a million.
BANDS, BAND_ROWS = 32, 5
#: Bytes of the shingle sets of one key that are compared in one task; more are dealt out in cells.
CELL_BYTES = 1 << 24
_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_SIGN = -(1 << 63)


def named(first_id: Column, content: Column) -> Column:
    """A binary name that sorts by ``first_id``, null last, then by ``content``."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(first_id, F.lit(0).cast("long")).bitwiseXOR(F.lit(_SIGN))), 16, "0"))
    return F.concat(F.when(first_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), number, content)


def name_id(name: Column) -> Column:
    """The ``first_id`` of a name."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.substring(name, 1, 1) == F.unhex(F.lit("00")), number)


def shingle_prints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id``, ``fingerprint`` long: the fingerprint of the text's word shingles, each as often as it occurs."""
    words = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.coalesce(F.length("text"), F.lit(0)).alias("_chars"), simhash.blank_words(simhash.ascii_lower(F.col("text"))).alias("_words"))
    prints = simhash.simhash(words, ["doc_id", "_text", "_chars"], "_words", shingle_words)
    return prints.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "fingerprint")


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def print_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each key and the key, of uint64 fingerprints."""
    rows, keys = [], []
    for half in range(2):
        bits = ((fingerprints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        other = ((fingerprints >> np.uint64(32 - 32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low, high = bits & ((1 << golay.LENGTH) - 1), bits >> golay.LENGTH
        row, near = golay.keys(low)
        own = np.concatenate([row, np.arange(len(bits))])
        fuzzy = np.concatenate([1 << 24 | high[row] << golay.MESSAGE | near, low])
        for byte in range(4):
            rows.append(own)
            keys.append((4 * half + byte) << 40 | (other[own] >> 8 * byte & 0xFF) << 32 | fuzzy)
    return np.concatenate(rows), np.concatenate(keys)


def _prints_of(nodes: pa.Array) -> np.ndarray:
    """uint64 fingerprints of a column of names, which end with them."""
    joined = b"".join(nodes.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(nodes), -1)[:, -8:].copy().view(">u8")[:, 0].astype(np.uint64)


def keyed(nodes: DataFrame) -> DataFrame:
    """``key`` long, ``node``: every key of every fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("node")
                rows, keys = print_keys(_prints_of(column))
                for at in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), column.take(pa.array(rows[at : at + (1 << 16)]))], names=["key", "node"])

    return nodes.select("node").mapInArrow(run, "key long, node binary")


def links(nodes: DataFrame, most_bits: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a``, ``b``: for every key a spanning forest of its fingerprints that differ in at most ``most_bits`` bits."""
    keys = keyed(nodes)
    large = keys.groupBy("key").count().where(F.col("count") > cell_rows).select("key", F.ceil(F.col("count") / cell_rows).cast("int").alias("cells")).checkpoint()
    if large.isEmpty():
        cells = keys.withColumn("cell", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("long")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1))
        dealt = keys.join(large, "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1))).withColumn("own", own).withColumn("other", other)
        cells = dealt.select("key", "node", (F.least("own", "other") * F.col("cells") + F.greatest("own", "other")).alias("cell"))
    met = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            at = np.stack([held.column("key").to_numpy(), held.column("cell").to_numpy()], axis=1)
            last = len(at) - int(np.argmin((at[::-1] == at[-1]).all(axis=1))) if len(at) and not (at == at[-1]).all() else 0
            if last:
                yield from _linked(held.slice(0, last), at[:last], most_bits)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from _linked(held, np.stack([held.column("key").to_numpy(), held.column("cell").to_numpy()], axis=1), most_bits)

    return met.mapInArrow(run, "a binary, b binary").distinct()


def _linked(rows: pa.Table, at: np.ndarray, most_bits: int) -> Iterator[pa.RecordBatch]:
    nodes = rows.column("node").combine_chunks()
    a, b = run_links(_prints_of(nodes), at, most_bits)
    if len(a):
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


def run_links(prints: np.ndarray, at: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal ``at``, as pairs of rows: all of short runs, a spanning forest of long ones."""
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
    sizes = np.diff(np.concatenate([first, [len(at)]]))
    run, short = np.repeat(np.arange(len(first)), sizes), np.repeat(sizes <= _ALL_PAIRS, sizes)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, min(_ALL_PAIRS, len(at))):
        i = np.flatnonzero((run[:-k] == run[k:]) & short[:-k])
        i = i[_distance(prints[i], prints[i + k]) <= most_bits]
        a.append(i)
        b.append(i + k)
    for r in np.flatnonzero(sizes > _ALL_PAIRS):
        x, y = spanning_links(prints[first[r] : first[r] + sizes[r]], most_bits)
        a.append(first[r] + x)
        b.append(first[r] + y)
    return np.concatenate(a), np.concatenate(b)


def spanning_links(prints: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that links rows of at most ``most_bits`` differing bits.

    Rows gather round pivots first.  Two rows of different pivots can be linked only if the pivots are within three
    times the radius of each other, and need comparing only if their groups aren't joined yet.
    """
    rest, pivots, members, links_ = np.arange(len(prints)), [], [], []
    while len(rest):
        near = _distance(prints[rest], prints[rest[0]]) <= most_bits
        pivots.append(rest[0])
        members.append(rest[near])
        links_ += [(rest[0], x) for x in rest[near][1:]]
        rest = rest[~near]
    root = list(range(len(pivots)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    centre = prints[pivots]
    for i in range(len(pivots)):
        for j in i + 1 + np.flatnonzero(_distance(centre[i + 1 :], centre[i]) <= 3 * most_bits):
            if find(i) == find(int(j)):
                continue
            for x in members[i]:
                hit = np.flatnonzero(_distance(prints[members[j]], prints[x]) <= most_bits)
                if len(hit):
                    links_.append((x, members[j][hit[0]]))
                    root[find(i)] = find(int(j))
                    break
    pairs = np.array(links_, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def grouped(prints: DataFrame, most_bits: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``prints`` (``doc_id``, ``fingerprint``) with ``component_id``, the smallest ``doc_id`` of its group.

    Fingerprints are linked exactly up to 3 bits.
    """
    checkpoint_dir(prints.sparkSession)
    prints = prints.checkpoint()
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = nodes.select("fingerprint", "copies", named(F.col("first_id"), F.unhex(simhash.as_hex(F.col("fingerprint")))).alias("node")).checkpoint()
    return _with_group(prints, nodes, "fingerprint", links(nodes, most_bits, cell_rows))


def _with_group(rows: DataFrame, nodes: DataFrame, key: str, found_links: DataFrame) -> DataFrame:
    """``rows`` with ``component_id``, by the node (``key``, ``copies``, ``node``) of their key."""
    found = nodes.join(components(found_links), "node", "left").select(key, "copies", name_id(F.coalesce("root", "node")).alias("component_id")).checkpoint()
    total = found.agg(F.sum("copies")).first()[0] or 0
    return spread_join(rows, found, [key], "copies", total).drop("copies")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, most_bits: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` long, ``component_id``: groups of texts by their shingles' SimHash."""
    if most_bits > RADIUS:
        raise ValueError(f"keys are sure to be shared up to {RADIUS} bits")
    return grouped(shingle_prints(docs, shingle_words), most_bits).select("doc_id", "fingerprint", "component_id")


def text_shingles(text: str | None, shingle_words: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles; one of fewer words has its whole sequence, a blank one none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(shingle_words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total += h[k : len(h) - n + 1 + k]
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(total)


def set_print(shingles: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingle hashes, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        votes += np.unpackbits(shingles[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view(np.int64)[0])


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band of ``rows`` MinHash values; two sets share a given one with their similarity to the power ``rows``."""
    seeds, factors = _hash_family(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(least, ((shingles[at : at + 512, None] ^ seeds) * factors).min(axis=0), out=least)
        key = np.arange(bands, dtype=np.uint64)
        for k in range(rows):
            key = _mix((key + least[k::rows]) * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


@functools.lru_cache(maxsize=4)
def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return x[:n], x[n:] | np.uint64(1)


def shingle_keys(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id``, ``text_hash`` long, ``set`` binary (a hash of the text's shingle set), ``shingles`` long (their number).

    Besides ``fingerprint`` long, the set's SimHash, and ``keys``, its MinHash keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = text_shingles(text, shingle_words)
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(set_print(own))
                keys.append(band_keys(own) if len(own) else np.empty(0, np.int64))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "set", "shingles", "fingerprint", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, set binary, shingles long, fingerprint long, keys array<long>")


def print_groups(nodes: DataFrame, most_bits: int = GROUP_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``nodes`` with ``near`` long: a fingerprint for each component of those that share a Golay key and differ in at most ``most_bits`` bits."""
    prints = nodes.select("fingerprint").distinct().select(F.unhex(simhash.as_hex(F.col("fingerprint"))).alias("node")).checkpoint()
    number = lambda c: F.conv(F.hex(c), 16, -10).cast("long")
    roots = components(links(prints, most_bits, cell_rows)).select(number("node").alias("fingerprint"), number("root").alias("root"))
    return nodes.join(roots, "fingerprint", "left").withColumn("near", F.coalesce("root", "fingerprint")).drop("root")


def similar_links(docs: DataFrame, nodes: DataFrame, shingle_words: int, least: float, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``a``, ``b``: a spanning forest of the sets of ``nodes`` with a Jaccard similarity of ``least`` or more.

    Every group of near fingerprints is compared, and those that share a MinHash key unless all lie in one group.  Of keys
    with the same members one is compared.  Only the sets of texts that share a key are sent, and every link is checked
    on the whole sets.
    """
    near = print_groups(nodes).where("shingles > 0").select("node", "near", "shingles", "keys").checkpoint()
    by_print = near.select(F.xxhash64(F.lit("near"), "near").alias("key"), F.lit(True).alias("by_print"), "near", "node", "shingles")
    by_band = near.select(F.explode(F.array_distinct("keys")).alias("key"), F.lit(False).alias("by_print"), "near", "node", "shingles")
    keyed_ = by_print.unionByName(by_band)
    met = keyed_.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.sum(8 * F.col("shingles")).alias("bytes"), F.max("by_print").alias("by_print"), (F.min("near") != F.max("near")).alias("parted"))
    met = met.where((F.col("n") > 1) & (F.col("by_print") | F.col("parted")))
    chosen = met.groupBy("n", "members", "bytes").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("bytes") / cell_bytes).cast("long").alias("cells"))
    members = keyed_.join(chosen, "key").select("key", "cells", "node").checkpoint()
    wanted = members.select("node").distinct().join(nodes.select("node", "one"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_shingles(text, shingle_words).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    wanted = wanted.select("node", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
    sent = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash"))).select("node", "text").mapInArrow(sets, "node binary, set binary")
    own = F.pmod(F.xxhash64("node"), F.col("cells"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    dealt = members.withColumn("own", own).withColumn("other", other).select("key", "node", (F.least("own", "other") * F.col("cells") + F.greatest("own", "other")).alias("cell"))
    rows = dealt.join(sent.groupBy("node").agg(F.first("set").alias("set")), "node")
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run_nodes, run_sets = None, [], []
        for batch in batches:
            for key, cell, node, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "node", "set"))):
                if (key, cell) != at:
                    yield from _similar(run_nodes, run_sets, least)
                    at, run_nodes, run_sets = (key, cell), [], []
                run_nodes.append(node)
                run_sets.append(np.frombuffer(packed, np.uint64))
        yield from _similar(run_nodes, run_sets, least)

    return rows.select("key", "cell", "node", "set").mapInArrow(run, "a binary, b binary").distinct()


def _similar(nodes: list[bytes], sets: list[np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    if len(pairs := similar_pairs(sets, least)):
        yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in side], pa.binary()) for side in zip(*pairs)], names=["a", "b"])


def similar_pairs(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links sets with a Jaccard similarity of ``least`` or more.

    Rows gather round pivots as in :func:`spanning_links`; 1 - similarity is a metric too.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # values of a single set are in no intersection
    shared = np.bincount(ids, minlength=len(values))[ids] > 1
    ids, owner = ids[shared], owner[shared]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    marked = np.zeros(len(values), bool)

    def likeness(x: int, rows: np.ndarray, of: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of set ``x`` and each of ``rows``, whose values are ``of`` at places ``place`` of ``rows``."""
        mine = ids[bounds[x] : bounds[x + 1]]
        marked[mine] = True
        common = np.bincount(place[marked[of]], minlength=len(rows))
        marked[mine] = False
        return common / (sizes[x] + sizes[rows] - common)

    def values_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = bounds[rows + 1] - bounds[rows]
        place = np.repeat(np.arange(len(rows)), counts)
        return ids[np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[rows], counts)], place

    rest, links_, pivots, members, near = np.arange(len(sets)), [], [], [], []
    of, place = ids, owner
    while len(rest):
        alike = likeness(rest[0], rest, of, place)
        alike[0] = 1.0
        in_ = alike >= least
        pivots.append(int(rest[0]))
        members.append(rest[in_])
        links_ += [(pivots[-1], int(x)) for x in rest[in_][1:]]
        near.append(rest[~in_ & (alike >= 1 - 3 * (1 - least) - 1e-9)])
        held = ~in_[place]
        of, place = of[held], (np.cumsum(~in_) - 1)[place[held]]
        rest = rest[~in_]
    number = {x: k for k, x in enumerate(pivots)}
    root = list(range(len(pivots)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(pivots)):
        for x in near[i]:
            j = number.get(int(x))
            if j is None or find(i) == find(j) or len(members[i]) == len(members[j]) == 1:
                continue
            few, many = sorted((members[i], members[j]), key=len)
            of, place = values_of(many)
            for y in few:
                hit = np.flatnonzero(likeness(y, many, of, place) >= least)
                if len(hit):
                    links_.append((int(y), int(many[hit[0]])))
                    root[find(i)] = find(j)
                    break
    return links_


def _linked_sets(docs: DataFrame, shingle_words: int, least: float, cell_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets (:func:`shingle_keys`), the different sets (``node``, ``one``: the first row that has it), and their links."""
    checkpoint_dir(docs.sparkSession)
    rows = shingle_keys(docs, shingle_words).checkpoint()
    one = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    nodes = rows.groupBy("set").agg(F.min(one).alias("one"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"))
    nodes = nodes.withColumn("node", named(F.col("one.doc_id"), F.col("set"))).checkpoint()
    return rows.select("doc_id", "text_hash", "set"), nodes, similar_links(docs, nodes, shingle_words, least, cell_bytes)


def alike(docs: DataFrame, shingle_words: int = 5, least: float = 0.8, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``doc_id``, ``text_hash``, ``component_id``: groups of texts whose different shingles have a Jaccard similarity of ``least``."""
    rows, nodes, found = _linked_sets(docs, shingle_words, least, cell_bytes)
    return _with_group(rows, nodes.select("set", "copies", "node"), "set", found).select("doc_id", "text_hash", "component_id")


def keep_first(docs: DataFrame, shingle_words: int = 5, least: float = 0.8, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """One row of ``docs`` for each group: of those with the smallest ``doc_id`` (null last) the one of the smallest text hash.

    Texts are linked if their different shingles have a Jaccard similarity of ``least`` or more.
    """
    rows, nodes, found = _linked_sets(docs, shingle_words, least, cell_bytes)
    later = components(found).where("node != root").select("node")
    several = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "copies")
    firsts = nodes.join(later, "node", "left_anti").select("one.doc_id", "one.text_hash")
    firsts = firsts.join(several, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text_hash", F.coalesce("copies", F.lit(1)).alias("copies")).checkpoint()

    key, hash_, copies = (fresh(c, docs.columns) for c in ("key", "hash", "copies"))
    first_key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias(key), F.concat(F.col("doc_id").isNull().cast("string"), F.col("text_hash").cast("string")).alias(hash_)]
    keyed_docs = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), hash_: F.concat(F.col("doc_id").isNull().cast("string"), F.xxhash64("text").cast("string"))})
    single = keyed_docs.join(firsts.where("copies = 1").select(*first_key), [key, hash_], "left_semi").select(*docs.columns)
    repeated = firsts.where("copies > 1").select(*first_key, F.col("copies").alias(copies)).checkpoint()
    if repeated.isEmpty():
        return single
    met = spread_join(keyed_docs, repeated, [key, hash_], copies, repeated.agg(F.sum(copies)).first()[0])
    return single.unionByName(met.dropDuplicates([key, hash_]).select(*docs.columns))
