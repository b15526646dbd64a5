"""Ordered operators that split a key: positions, running sums and previous rows by ranges.

Rows are dealt by ranges of (keys, order), so a key with a third of all rows is spread over many tasks.  Work goes on
within a range; what crosses ranges is one row for each key and range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; a folder of this machine where it is unset and the master is local, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            import tempfile

            shared = f"file://{tempfile.gettempdir()}/sylva-checkpoints"
        spark.sparkContext.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The path of a folder that is mounted as a file system, from a path or a ``file:`` address with any number of slashes.

    Anything else would be taken for a relative path, in whatever folder a process happens to run.
    """
    path = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
    if not path.startswith("/"):
        raise ValueError(f"not an absolute path of a mounted file system: {uri}")
    return path


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``range_``, fixed by a checkpoint: bounds drawn anew could differ."""
    checkpoint_dir(rows.sparkSession)
    return rows.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()).checkpoint()


def _same(keys: list[str], other: dict[str, str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(other[k]))
    return on


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row of its key; ties in ``order`` are broken arbitrarily."""
    placed = ranged(rows.withColumn("value_", value), keys, order)
    totals = placed.groupBy(*keys, "range_").agg(F.sum("value_").alias("total_"))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    other = {k: f"{k}__" for k in keys}
    offsets = totals.select(*(F.col(k).alias(other[k]) for k in keys), F.col("range_").alias("range__"), F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("offset_"))
    inside = Window.partitionBy(*keys, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("inner_", F.sum("value_").over(inside))
    return summed.join(offsets, _same(keys, other) & (F.col("range_") == F.col("range__"))).select(*rows.columns, (F.col("inner_") + F.col("offset_")).alias(into))


def positions(rows: DataFrame, keys: list[str], order: list[str], into: str = "pos") -> DataFrame:
    """``rows`` with their place within their key, from 1."""
    return running_sum(rows, keys, order, F.lit(1).cast("long"), into)


def with_previous(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``rows`` with values of the row before within the key: ``columns`` maps a column to its new name.

    The first row of a range takes the last row of the key in an earlier range.
    """
    placed = ranged(rows, keys, order)
    row = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))
    last = placed.groupBy(*keys, "range_").agg(F.max_by(row, F.struct(*order)).alias("last_"))
    other = {k: f"{k}__" for k in keys}
    by_range = Window.partitionBy(*keys).orderBy("range_")
    carried = last.select(*(F.col(k).alias(other[k]) for k in keys), F.col("range_").alias("range__"), F.lag("last_").over(by_range).alias("carried_"))
    inside = Window.partitionBy(*keys, "range_").orderBy(*order)
    led = placed.withColumn("inner_", F.lag(row).over(inside)).join(carried, _same(keys, other) & (F.col("range_") == F.col("range__")))
    before = F.coalesce("inner_", "carried_")
    return led.select(*rows.columns, *(before[f"c{k}"].alias(name) for k, name in enumerate(columns.values())))
