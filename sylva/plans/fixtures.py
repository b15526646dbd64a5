"""Files, sides of a merge, histories and changes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators.ordering import with_previous

CLIENT, CONFLICT_MS = "desk-7", 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: ``doc_id``, ``source``, ``lang``, ``path``, ``blob_id``, ``size``, ``mtime``."""
    text, source, lang = (F.coalesce(c, F.lit(d)) for c, d in (("text", ""), ("source", "_"), ("lang", "_")))
    path = F.concat(source, F.lit("/"), lang, F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), lang.alias("lang"), path.alias("path"), F.sha2(text.cast("binary"), 256).alias("blob_id"), F.octet_length(text).cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose names end in every way: no dot, one, several, a trailing or a leading one."""
    own = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    kind = F.col("doc_id") % 5
    name = F.when(kind == 0, own).when(kind == 1, F.concat(own, F.lit(".txt"))).when(kind == 2, F.concat(own, F.lit(".tar.gz"))).when(kind == 3, F.concat(own, F.lit("."))).otherwise(F.concat(F.lit("."), own))
    return files(spark, sf_dir).select("doc_id", "mtime", F.concat("source", F.lit("/"), name).alias("path"))


def merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ancestor, ours and theirs: edits, deletions, empty directories, and paths that take a copy's name."""
    base = files(spark, sf_dir).select("doc_id", "source", "lang", "path", "blob_id")
    named = base.where(F.col("doc_id") % 13 == 0).withColumn("path", paths.conflict_name(F.col("path"), F.lit(CLIENT), F.lit(CONFLICT_MS)))
    plain = ["path", "blob_id"]
    dirs = base.select("lang", F.concat("source", F.lit("/empty-"), "lang").alias("path")).distinct()
    marker = F.lit(paths.DIR_MARKER).alias("blob_id")
    fixed = named.select(*plain)
    edited = lambda who, every: F.when(F.col("doc_id") % every == 0, F.concat(F.lit(who), "blob_id")).otherwise(F.col("blob_id")).alias("blob_id")
    ancestor = base.select(*plain).unionByName(fixed).unionByName(dirs.select("path", marker))
    ours = base.where(F.col("doc_id") % 7 != 0).select("path", edited("ours-", 5)).unionByName(fixed).unionByName(dirs.where("lang != 'de'").select("path", marker))
    theirs = base.where(F.col("doc_id") % 11 != 0).select("path", edited("theirs-", 3)).unionByName(fixed).unionByName(dirs.select("path", F.when(F.col("lang") == "fr", F.lit("blob")).otherwise(paths.DIR_MARKER).alias("blob_id")))
    return ancestor, ours, theirs


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a target directory that no side of the merge has."""
    base = files(spark, sf_dir).where(F.col("doc_id") % 10 == 0)
    return base.select(F.concat(F.lit("stale/"), "lang", F.lit("/x-"), F.col("doc_id").cast("string")).alias("path"), "blob_id")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision for each order, in its customer's tree.

    Its predecessor is the order before; for keys divisible by 7 the one before that, which forks the tree, and for
    keys divisible by 11 both, which merges.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree"), F.col("o_orderkey").alias("time_id"), F.col("o_orderdate").alias("ts"))
    led = with_previous(orders, ["tree"], ["ts", "time_id"], {"time_id": "one"})
    led = with_previous(led, ["tree"], ["ts", "time_id"], {"one": "two"})
    found = F.when(F.col("time_id") % 7 == 0, F.array("two")).when(F.col("time_id") % 11 == 0, F.array("one", "two")).otherwise(F.array("one"))
    ref = lambda key: F.concat(F.lit("r"), F.floor(key / 4).cast("string"))
    previous = F.filter(found, lambda p: p.isNotNull())
    return led.select("tree", "time_id", "ts", ref(F.col("time_id")).alias("ref"), previous.alias("previous"), F.transform(previous, ref).alias("parent_refs"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts", "event_id", "event_type")
