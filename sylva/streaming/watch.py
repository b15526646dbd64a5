"""Watching a directory: what differs from the last snapshot becomes rows of a stream.

The changes come from :mod:`sylva.sources.directory_stream` and are appended to a Parquet folder by Spark's file sink, which
records each batch as a whole.  A step that fails anywhere is repeated by the next one with the same snapshot, so no
change is lost or written twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylva.functions import paths
from sylva.sources import directory_stream

CHANGES = directory_stream.SCHEMA


@dataclass
class Watch:
    """A directory ``root`` and the folder ``path`` of its snapshots, its changes and the stream's progress."""

    spark: SparkSession
    root: str
    path: str
    ignore: tuple[str, ...] = paths.DEFAULT_IGNORE
    #: Whether files are compared by content, or by size and time of change alone.
    content: bool = True

    def source(self) -> DataFrame:
        return directory_stream.changes(self.spark, self.root, f"{self.path}/snapshots", self.ignore, self.content)

    def _query(self, **trigger) -> StreamingQuery:
        writer = self.source().writeStream.format("parquet").option("checkpointLocation", f"{self.path}/progress")
        return writer.trigger(**trigger).start(f"{self.path}/changes")

    def step(self) -> int:
        """Writes what differs from the snapshot before; the number of the step's own.

        The first step's changes are all entries, as added.  A step that failed is repeated first.
        """
        self._query(availableNow=True).awaitTermination()
        return directory_stream.Snapshots(f"{self.path}/snapshots").numbers()[-1]

    def written(self) -> DataFrame:
        """The changes of all steps so far."""
        return self.spark.read.schema(CHANGES).parquet(f"{self.path}/changes")

    def changes(self) -> DataFrame:
        """The changes of all steps as a stream."""
        return self.spark.readStream.schema(CHANGES).parquet(f"{self.path}/changes")

    def latest(self) -> DataFrame:
        """``path``, ``change``: the last change of each path."""
        return self.written().groupBy("path").agg(F.max_by("change", "step").alias("change"))

    def start(self, every: str = "30 seconds") -> StreamingQuery:
        """Starts a query that makes a step at every trigger."""
        return self._query(processingTime=every)
