"""From raw documents to token ids in five stages, each written as Parquet and read again as the next one's input.

1. Language identification drops documents without a known language.
2. Near-deduplication keeps the document of the smallest id of each group of near copies.
3. Substring deduplication cuts passages of 50 words or more that an earlier document has, and drops documents
   that consist of them alone.
4. Decontamination drops documents that hold a window of the benchmark.
5. Byte-level BPE encodes what is left and checks that the ids decode to the text.

The stages but the last return the columns of ``documents``, and keep further ones whatever their names.

Defined results: documents with a null or empty text, or one without a letter, go in the first stage; a null ``doc_id``
is kept like any other, and is the last of its group; of rows that repeat, or stand under one ``doc_id`` with near
copies of one text, one stays; very long texts pass every stage whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import bpe, decontam, langid, neardup, substring
from sylva.llm.queries import multilingual_vocabulary
from sylva.llm.tables import id_residue, scratch_path, small_batches, table

#: Near copies: words of a shingle, and the least Jaccard similarity of two texts' different shingles.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that aren't typical of the language that is the likeliest."""
    small_batches(spark)
    model = langid.train(docs, id_residue(F.col("doc_id"), 3) != 1)
    return langid.keep_known(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies."""
    small_batches(spark)
    return neardup.keep_first(docs, SHINGLE_WORDS, LEAST_SIMILARITY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat across documents from all but the document of the smallest id."""
    return substring.remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    small_batches(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each document's ids."""
    small_batches(spark)
    return bpe.encoded_digests(docs, multilingual_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The first two stages are a fitted model and a fuzzy hash, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; the tables between them are in the folder the cluster shares."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
