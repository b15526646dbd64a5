"""Ranked lexical search with each bag of words scored once.

A document is restricted to the vocabulary of the items: what is left is a bag, the counts ``tf`` of those terms, beside
its number of words.  Bags of equal counts and equal ``m`` have equal scores for every item, so documents are gathered
into such classes, by a hash and then by the bag itself, and only classes are scored.  An item's best documents lie in its
best classes, by score and smallest document; the documents of these are then listed in ascending order.

Items are taken in blocks of a bounded size of text, each with its own vocabulary, sent to the tasks, and its own pass over
the documents; one item of more than that is a block of its own.  Numbers and weights are those of all documents in any case.

Defined results: null texts, of documents or items, have no terms; documents of equal score are ordered by ``doc_id``,
null last; rows that repeat, of documents or items, are each found and each ranked; an empty table on either side
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.decontam import normalise
from sylva.llm.tables import checkpoint_dir, scratch_path
from sylva.operators.ordering import running_sum

#: Bytes of item texts in a block.
BLOCK_BYTES = 4 << 20
#: Classes that are scored at once, and the most names of classes (8 bytes each) that are broadcast.
CLASS_ROWS, MOST_SENT = 256, 100_000


def ranked(docs: DataFrame, items: DataFrame, most: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id``, ``score``: the ``most`` best documents of each item."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = items.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("row"))
    sized = running_sum(rows, [], ["item_id", "row"], F.octet_length("text").cast("long"), "end").withColumn("block", F.floor((F.col("end") - F.octet_length("text")) / block_bytes)).checkpoint()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in [r["block"] for r in sized.select("block").distinct().orderBy("block").collect()]:
        own = [(r["item_id"], r["text"]) for r in sized.where(F.col("block") == block).select("item_id", "text").collect()]
        out = out.unionByName(_block(docs, own, most))
    return out


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (words), ``bag``: the terms' numbers, ascending, and their counts behind them, as 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n, found = [], []
            for text in batch.column("text"):
                words = normalise(text.as_py())
                counts = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                n.append(len(words))
                found.append(np.array(counts, "<u4").T.tobytes() if counts else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n", "bag"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, bag binary")


def classes(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``name`` (a hash), ``bag``, ``m``, ``members`` and ``first_id`` (null last) of each different bag and ``m``.

    The hash deals and finds equal bags; they are the same class only if the bags themselves are equal.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id"))
    return named(rows, n_docs, n_terms).groupBy("name", "bag", "m").agg(F.count("*").alias("members"), first.alias("first_"))


def named(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L")
    return rows.where(F.octet_length("bag") > 0).select("doc_id", "bag", m.alias("m")).withColumn("name", F.xxhash64("bag", "m"))


def weights(found: DataFrame, n_docs: int, n_vocabulary: int) -> np.ndarray:
    """The weight of each term; that of a term which no document has isn't used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_vocabulary, np.int64)
        for batch in batches:
            for bag, members in zip(batch.column("bag").to_pylist(), batch.column("members").to_pylist()):
                total[np.frombuffer(bag, "<u4")[: len(bag) // 8]] += members
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    df = {r["term"]: r["df"] for r in found.select("bag", "members").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(n_vocabulary)], np.int64)


class Scorer:
    """Scores of bags for all items of a block; keeps each item's ``most`` best classes of a task."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray, most: int):
        self.weight, self.most, self.n = weight, most, len(terms)
        # items of each term
        sizes = [len(t) for t in terms]
        flat = np.concatenate(terms) if terms else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.items = np.repeat(np.arange(self.n), sizes)[order]
        self.ends = np.searchsorted(flat[order], np.arange(len(weight) + 1))
        self.best: list[list[tuple]] = [[] for _ in terms]
        self.floor = np.ones(self.n, np.int64)

    def scores(self, bags_: list[bytes], m: np.ndarray) -> np.ndarray:
        """One row for each bag, one column for each item; whole numbers throughout."""
        sizes = np.array([len(b) // 8 for b in bags_])
        pairs = [np.frombuffer(b, "<u4").reshape(2, -1) for b in bags_]
        term, tf = (np.concatenate([p[k] for p in pairs]).astype(np.int64) for k in (0, 1))
        row = np.repeat(np.arange(len(bags_)), sizes)
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        out = np.zeros(len(bags_) * self.n, np.int64)
        held = self.ends[term + 1] - self.ends[term]
        # each term of a bag counts for each item that has it; a bag's terms are added one round after the other
        turn = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(self.ends[term], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        place, add = np.repeat(row, held) * self.n + self.items[at], np.repeat(value, held)
        if len(add) and np.abs(value).max() * int(turn.max() + 1) < 1 << 53:
            return np.bincount(place, weights=add, minlength=len(out)).astype(np.int64).reshape(-1, self.n)
        np.add.at(out, place, add)
        return out.reshape(-1, self.n)

    def add(self, numbers: list[int], first: list[tuple], bags_: list[bytes], m: np.ndarray) -> None:
        found = self.scores(bags_, m)
        for row, item in zip(*np.nonzero(found >= self.floor)):
            own = self.best[item]
            own.append((-int(found[row, item]), first[row], numbers[row]))
            if len(own) >= 2 * self.most:
                self._cut(item)

    def _cut(self, item: int) -> None:
        own = self.best[item]
        own.sort()
        del own[self.most :]
        if len(own) == self.most:
            self.floor[item] = max(1, -own[-1][0])


def _block(docs: DataFrame, items: list[tuple[int | None, str]], most: int) -> DataFrame:
    spark = docs.sparkSession
    words = [sorted(set(normalise(text))) for _, text in items]
    vocabulary = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
    terms = [np.array([vocabulary[w] for w in own], np.int64) for own in words]
    path = scratch_path(spark, "bags")
    bags(docs, vocabulary).write.parquet(path)
    rows = spark.read.schema("doc_id long, n long, bag binary").parquet(path)
    total = rows.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    # a class has a number, so that its bag needn't travel with its scores
    found = classes(rows, total["n_docs"], total["n_terms"]).withColumn("class", F.monotonically_increasing_id()).checkpoint()
    weight = weights(found, total["n_docs"], len(vocabulary))
    sent = spark.sparkContext.broadcast((terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value, most)
        for batch in batches:
            numbers, bag, m, nameless, first = (batch.column(c) for c in ("class", "bag", "m", "nameless", "first_id"))
            columns = numbers.to_pylist(), list(zip(nameless.to_pylist(), (x or 0 for x in first.to_pylist()))), bag.to_pylist(), m.to_numpy()
            for a in range(0, batch.num_rows, CLASS_ROWS):
                scorer.add(*(c[a : a + CLASS_ROWS] for c in columns))
        for item, own in enumerate(scorer.best):
            scorer._cut(item)
            score, first, number = zip(*own) if own else ((),) * 3
            columns = [pa.array([item] * len(own), pa.int32()), pa.array([-s for s in score], pa.int64()), pa.array([f[0] for f in first], pa.bool_()), pa.array([f[1] for f in first], pa.int64()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "nameless", "first_id", "class"])

    scored = found.select("class", "bag", "m", "first_.nameless", F.col("first_.doc_id").alias("first_id")).mapInArrow(run, "item int, score long, nameless boolean, first_id long, class long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "nameless", "first_id", "class"))
    best = scored.withColumn("place", place).where(F.col("place") <= most).select("item", "score", "class").checkpoint()
    # the smallest documents of the chosen classes, as many as an item can have; Spark keeps that many before it shuffles
    chosen = found.select("class", "name", "bag", "m").join(best.select("class").distinct(), "class", "left_semi").checkpoint()
    names = chosen.select("name").distinct()
    candidates = named(rows, total["n_docs"], total["n_terms"]).join(F.broadcast(names) if len(items) * most <= MOST_SENT else names, "name", "left_semi")
    member = F.row_number().over(Window.partitionBy("name", "bag", "m").orderBy(F.asc_nulls_last("doc_id")))
    members = candidates.withColumn("member", member).where(F.col("member") <= most).join(chosen, ["name", "bag", "m"]).select("class", "doc_id")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    out = best.join(members, "class").withColumn("rank", rank).where(F.col("rank") <= most)
    return out.join(ids, "item").select("item_id", "rank", "doc_id", "score")
