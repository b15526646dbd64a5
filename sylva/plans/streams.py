"""Registered queries that run a stream over a whole table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.operators.ordering import shared_folder
from sylva.plans.catalogue import query
from sylva.plans.fixtures import table
from sylva.streaming import batches, changes, keyed


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # a pattern, since a stream takes a plain path for a folder, and the table may be one file
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")


def _last_micros(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0


def _closing(spark: SparkSession, micros: int) -> DataFrame:
    """A stream of one row of no client, at ``micros``: its watermark closes all bursts that are open before."""
    path = shared_folder(spark, "closing")
    row = spark.range(1).select(F.lit(None).cast("long").alias("client"), F.timestamp_micros(F.lit(micros)).alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"))
    row.write.parquet(path)
    return spark.readStream.schema(row.schema).parquet(path)


def _run(stream: DataFrame) -> DataFrame:
    """Writes a stream's result to the shared folder until its source is read, and reads it."""
    spark, base = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    schema = stream.schema
    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/rows").awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows")


@query
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bursts of the table; a closing row moves the watermark past the last one's quiet gap."""
    end = _last_micros(spark, sf_dir) + 2 * (6 + 1) * 3_600_000_000
    return _run(changes.debounce(_events(spark, sf_dir).unionByName(_closing(spark, end)))).where(F.unix_micros("first_ts") < end)


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of kind, with the last kind of each client kept from batch to batch."""
    folder, events = shared_folder(spark, "dedup"), _events(spark, sf_dir)
    batches.without_repeats(events, folder, ["client"], ["ts", "event_id"], "event_type").trigger(availableNow=True).start().awaitTermination()
    return batches.written(spark, folder, events.schema).select("client", "event_id", "event_type")


@query
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each burst of a client, given once the client has been quiet for six hours."""
    end = _last_micros(spark, sf_dir) + 2 * (6 + 1) * 3_600_000_000
    events = _events(spark, sf_dir).unionByName(_closing(spark, end))
    return _run(keyed.latest_when_quiet(events, ["client"], "ts", ["event_id"], "6 hours", "1 hour")).where(F.unix_micros("ts") < end).select("client", "ts", "event_id")


@query
def stream_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's kinds of event as refs that come again and again; every tenth event makes one invalid, so that it passes anew."""
    folder = shared_folder(spark, "received")
    refs = _events(spark, sf_dir).select("client", F.col("event_type").alias("ref"), "ts", (F.col("event_id") % 10 == 0).alias("invalid"))
    batches.not_received_before(refs, folder, ["client", "ref"]).trigger(availableNow=True).start().awaitTermination()
    return batches.written(spark, folder, refs.drop("invalid").schema)


@query
def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client and kind of event as a path that is present but for purchases."""
    path, folder = F.concat_ws("/", F.col("client").cast("string"), F.pmod(F.col("event_id"), F.lit(3)).cast("string")), shared_folder(spark, "classify")
    events = _events(spark, sf_dir).select(path.alias("path"), "ts", "event_id", (F.col("event_type") != "purchase").alias("present"))
    batches.classify(events, folder).trigger(availableNow=True).start().awaitTermination()
    return batches.written(spark, folder, T.StructType([*(events.schema[c] for c in ("path", "ts")), T.StructField("change", T.StringType())]))
