"""Connected components by alternating large-star and small-star steps, each checkpointed in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.tables import checkpoint_dir


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (columns ``a``, ``b``): the smallest node it is linked to.

    Links and nodes stay distributed; a hub's links are summed by partial minima and joined to one row, so its
    partition can be split.  Rounds grow with the logarithm of the longest chain.
    """
    checkpoint_dir(links.sparkSession)
    edges = links.where(F.col("a") != F.col("b")).select("a", "b").distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        edges = _small_star(_large_star(edges)).checkpoint()
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; every link ends at its smaller node."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
