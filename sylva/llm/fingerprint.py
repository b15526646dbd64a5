"""Document fingerprints: SimHash with a permuted-block search.

A text's terms are its word shingles; each term votes with its hash, weighted by how often it occurs, and the signs
of the 64 sums are the fingerprint.  To find everything within a Hamming radius, fingerprints are cut into blocks
and kept in one table for each choice of blocks that is as large as the errors allow: of ``blocks`` blocks, ``radius``
errors leave ``blocks - radius`` untouched, and in the table permuted by just these two neighbours have equal keys.

Defined results: a null or blank text has fingerprint zero; two texts that differ in case or white space alone have equal
fingerprints; rows of one ``doc_id`` are told apart and ordered by their text's hash; rows that repeat
are one document with the same result on each; a null ``doc_id`` comes first; a single document is its own next one;
further columns are ignored; an empty table gives no rows.  Everything is DataFrame operations.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm import simhash
from sylva.llm.tables import checkpoint_dir

SHINGLE_WORDS = 2
RADIUS, BLOCKS = 3, 5


def fingerprints(texts: DataFrame, keys: list[str], shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``keys``, ``fingerprint`` long, ``copies`` long of a table with a column ``text``.

    Rows of equal ``keys`` must have equal texts; they give one row.
    """
    words = texts.select(*keys, simhash.blank_words(simhash.ascii_lower(F.col("text"))).alias("words_"))
    return simhash.simhash(words, keys, "words_", shingle_words)


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits that stay, for each choice of ``blocks - radius`` of the blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("there must be more blocks than errors")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:])]
    signed = (sum(c) for c in itertools.combinations(block, blocks - radius))
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def _met(queries: DataFrame, prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``query``, ``fingerprint``, ``distance`` and the other columns of ``prints``: each pair in radius once.

    A pair meets in every table whose block it has in common, and counts in the first of them.
    """
    signed = block_masks(radius, blocks)
    masks = F.array(*(F.lit(m).cast("long") for m in signed))

    def tables(df: DataFrame, name: str) -> DataFrame:
        others = [c for c in df.columns if c != "fingerprint"]
        return df.select(F.col("fingerprint").alias(name), *others, F.posexplode(masks).alias("table", "mask")).select(name, *others, "table", F.col(name).bitwiseAND(F.col("mask")).alias("block"))

    differing = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*(F.when(differing.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(signed)))
    distance = F.bit_count(differing)
    asked = queries.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    pairs = tables(asked, "query").join(tables(prints, "fingerprint"), ["table", "block"])
    return pairs.where((distance <= radius) & (F.col("table") == first)).drop("table", "block").withColumn("distance", distance)


def find_within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``query``, ``fingerprint``, ``distance``: all different fingerprints of ``prints`` near one of ``queries``.

    Both have a long column ``fingerprint``; it is made distinct first, so copies don't multiply.
    """
    held = prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    return _met(queries, held, radius, blocks)


def count_within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``query``, ``n``: how many of ``prints`` (``fingerprint``, ``copies``) are near each different one of ``queries``.

    Pairs are added up where they meet; none leaves its task.
    """
    held = prints.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.sum("copies").alias("copies"))
    return _met(queries, held, radius, blocks).groupBy("query").agg(F.sum("copies").alias("n"))


def succession(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` with ``next_...`` columns: the following row in ascending ``order``, after the last the first.

    Rows are sorted by ranges; only the first row of each range is looked at beyond its range.
    """
    checkpoint_dir(keys.sparkSession)
    placed = keys.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).checkpoint()
    row = F.struct(*(F.col(c) for c in keys.columns))
    heads = placed.groupBy("range_").agg(F.min(F.struct(*(F.col(c) for c in order), row.alias("row_"))).alias("head_"))
    by_range = Window.orderBy("range_")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("range_", F.coalesce(F.lead("head_.row_").over(by_range), F.first("head_.row_").over(whole)).alias("after_"))
    inside = Window.partitionBy("range_").orderBy(*order)
    led = placed.withColumn("inner_", F.lead(row).over(inside)).join(following, "range_")
    after = F.coalesce("inner_", "after_")
    return led.select(*keys.columns, *(after[c].alias(f"next_{c}") for c in keys.columns))


#: Stands for a null id in joins.
_NO_ID = -(1 << 63)


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NO_ID).cast("long"))


def edited_likeness(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, queries_every: int = 20) -> DataFrame:
    """Fingerprints of texts, of the texts with the last half overwritten from the next document, and their likeness.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` long, ``near_edited``,
    ``near_next``, and ``n_near``: for ids divisible by ``queries_every`` the documents within the search radius.
    """
    # both joins below take the same columns, so that they share one shuffle of the texts
    texts = docs.select(_key(F.col("doc_id")).alias("key_"), F.coalesce("text", F.lit("")).alias("text")).select("key_", F.xxhash64("text").alias("hash_"), "text")
    doc_id = F.when(F.col("key_") != _NO_ID, F.col("key_"))
    rows = texts.groupBy("key_", "hash_").agg(F.max(F.length("text")).cast("long").alias("n"))
    order = succession(rows, ["key_", "hash_"]).checkpoint()

    # the start of each text goes to the document before it
    half = F.floor(F.col("n") / 2)
    given = texts.join(order.select(F.col("next_key_").alias("key_"), F.col("next_hash_").alias("hash_"), F.col("key_").alias("to_key"), F.col("hash_").alias("to_hash"), half.cast("int").alias("half")), ["key_", "hash_"])
    given = given.select("to_key", "to_hash", F.left("text", F.col("half")).alias("start")).dropDuplicates(["to_key", "to_hash"])
    own = texts.join(given, (F.col("key_") == F.col("to_key")) & (F.col("hash_") == F.col("to_hash")))
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.col("start"))
    both = own.select(doc_id.alias("doc_id"), "key_", "hash_", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    # the sum of an edited text's votes carries its checksum as part of its key
    sides = F.explode(F.array(F.struct(F.lit("").alias("sha"), F.col("text").alias("text")), F.struct(F.col("edited_sha256").alias("sha"), F.col("edited").alias("text"))))
    each = both.select("doc_id", "key_", "hash_", "n_chars", sides.alias("side")).select("doc_id", "key_", "hash_", "n_chars", "side.sha", "side.text")
    prints = fingerprints(each, ["doc_id", "key_", "hash_", "n_chars", "sha"], shingle_words).checkpoint()

    plain = prints.where("sha = ''").select("doc_id", "key_", "hash_", "n_chars", "fingerprint", "copies")
    changed = prints.where("sha != ''").select("key_", "hash_", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("edited_fingerprint"))
    after = prints.where("sha = ''").select(F.col("key_").alias("next_key_"), F.col("hash_").alias("next_hash_"), F.col("fingerprint").alias("next_fingerprint"))
    found = plain.join(changed, ["key_", "hash_"]).join(order.select("key_", "hash_", "next_key_", "next_hash_"), ["key_", "hash_"]).join(after, ["next_key_", "next_hash_"])

    asked = plain.where(F.col("doc_id") % queries_every == 0)
    near = count_within(asked, plain.select("fingerprint", "copies")).withColumnRenamed("n", "n_near")
    found = found.join(near, found["fingerprint"] == near["query"], "left")
    found = found.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.when(F.col("doc_id") % queries_every == 0, F.col("n_near")).alias("n_near"),
    )
