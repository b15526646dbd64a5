"""A folder for one piece of work: everything that it writes on the way goes when it ends, with its shuffle files."""

from __future__ import annotations

import contextlib
import gc
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from sylva.operators.ordering import checkpoint_dir


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Checkpoints and written tables of what runs inside lie in a new folder, which is removed at the end.

    The folder stands beside the present checkpoint folder, so all executors see it; it is removed after an error, too.
    Results must be written or counted inside: a DataFrame that leaves the block has lost its files.  A Spark
    application has one checkpoint folder, so blocks may be nested, but not run side by side in threads.
    """
    checkpoint_dir(spark)
    context = spark.sparkContext
    above = os.path.dirname(context.getCheckpointDir())
    folder = f"{above}/scratch-{uuid.uuid4().hex}"
    context.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        context.setCheckpointDir(above)
        hadoop = spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Shuffle files of DataFrames that nobody holds any more go; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
