"""Stream operators that compare a row with the one before it of its key, in any number of rows a key.

Each micro-batch is worked on as a table, where a key's rows are split by ranges (:mod:`sylva.operators.ordering`), and only
the last row of each key is remembered, as a row of a log in the shared folder.  A batch that is repeated after a failure
reads the log up to the batch before it and writes the same rows over its own, so results are given once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.operators.ordering import with_previous

#: Batches of a log after which it is written anew as one.
MERGE_EVERY = 20


@dataclass
class Log:
    """The last row of each key, as batches ``path/batch=n`` of which a later one's rows count."""

    spark: SparkSession
    path: str
    keys: list[str]
    schema: T.StructType

    def _read(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def before(self, number: int) -> DataFrame:
        """The last row of each key before batch ``number``."""
        # a merged batch holds all that came before it
        held = self._read().where(F.col("batch") < number)
        whole = F.struct(*(f.name for f in self.schema.fields))
        return held.groupBy(*self.keys).agg(F.max_by(whole, "batch").alias("last_")).select("last_.*")

    def write(self, number: int, rows: DataFrame, most_per: tuple[list[str], str, int] | None = None) -> None:
        """Writes a batch; every ``MERGE_EVERY`` the last rows of all keys in place of those that changed.

        ``most_per`` (columns, moment, number) keeps the latest so many rows of each value of the columns when it merges.
        """
        rows = rows.select(*self.schema.fieldNames())
        if number and number % MERGE_EVERY == 0:
            old = self.before(number).join(rows.select(*self.keys), self.keys, "left_anti")
            rows = old.unionByName(rows)
            if most_per is not None:
                from sylva.operators.ordering import positions

                columns, moment, most = most_per
                rows = positions(rows.withColumn("age_", -F.unix_micros(moment)), columns, ["age_", *self.keys], "place_").where(F.col("place_") <= most).select(*self.schema.fieldNames())
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if number and number % MERGE_EVERY == 0:
            self._drop(number)

    def _drop(self, number: int) -> None:
        """Removes batches that a merged one has made needless, but for those that its repetition would read."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in range(max(0, number - 3 * MERGE_EVERY), number - MERGE_EVERY):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={n}")
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                fs.delete(path, True)


def _types(rows: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])


def _in_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], DataFrame]):
    """A writer whose batches are ``folder/rows/batch=n``."""

    def run(batch: DataFrame, number: int) -> None:
        step(batch, number).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return stream.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(run)


def _led(batch: DataFrame, keys: list[str], order: list[str], value: str, last: DataFrame) -> DataFrame:
    """``batch`` with ``before_``, the value before within the key, and ``seen_``, true if there was any."""
    led = with_previous(batch.withColumn("has_", F.lit(True)), keys, order, {value: "own_", "has_": "own_seen_"})
    other = last.select(*(F.col(k).alias(f"{k}__") for k in keys), F.col(value).alias("last_"), F.lit(True).alias("last_seen_"))
    on: Column = F.col("own_seen_").isNull()
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    joined = led.join(other, on, "left")
    return joined.withColumns({"before_": F.when(F.col("own_seen_"), F.col("own_")).otherwise(F.col("last_")), "seen_": F.coalesce("own_seen_", "last_seen_")})


def _last(batch: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    whole = F.struct(*columns)
    return batch.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("last_")).select("last_.*")


def without_repeats(stream: DataFrame, folder: str, keys: list[str], order: list[str], value: str):
    """Starts from a writer: rows whose ``value`` differs from that of the row before within the key, across batches too.

    Rows of a batch are put in ``order``; rows of a later batch come after those of an earlier one.
    """
    log = Log(stream.sparkSession, f"{folder}/log", keys, _types(stream, [*keys, value]))

    def step(batch: DataFrame, number: int) -> DataFrame:
        led = _led(batch, keys, order, value, log.before(number))
        log.write(number, _last(batch, keys, order, [*keys, value]))
        return led.where(F.col("seen_").isNull() | ~F.col(value).eqNullSafe(F.col("before_"))).select(*batch.columns)

    return _in_batches(stream, folder, step)


def not_received_before(stream: DataFrame, folder: str, keys: list[str], ts: str = "ts", invalid: str = "invalid", ttl: str | None = None, most_per: tuple[list[str], int] | None = None):
    """Starts from a writer: refs that come for the first time, or for the first time since they were made invalid.

    Rows for which ``invalid`` holds make a ref invalid and aren't given out; of rows at one moment they come first.
    What is remembered is forgotten ``ttl`` (an interval) after the ref last came, and of more than ``most_per[1]`` refs of each
    value of ``most_per[0]`` the oldest are, when the log is merged.
    """
    spark = stream.sparkSession
    log = Log(spark, f"{folder}/log", keys, _types(stream, [*keys, ts, invalid]))

    def step(batch: DataFrame, number: int) -> DataFrame:
        batch = batch.withColumn(invalid, F.coalesce(invalid, F.lit(False))).withColumn("late_", ~F.col(invalid))
        led = _led(batch.withColumn("was_", F.struct(invalid, ts)), keys, [ts, "late_"], "was_", log.before(number).withColumn("was_", F.struct(invalid, ts)))
        log.write(number, _last(batch, keys, [ts, "late_"], [*keys, ts, invalid]), None if most_per is None else (most_per[0], ts, most_per[1]))
        known = F.col("seen_") & ~F.col("before_")[invalid]
        if ttl is not None:
            known = known & (F.col("before_")[ts] + F.expr(f"INTERVAL {ttl}") > F.col(ts))
        return led.where(~F.col(invalid) & ~F.coalesce(known, F.lit(False))).select(*(c for c in stream.columns if c != invalid))

    return _in_batches(stream, folder, step)


def classify(stream: DataFrame, folder: str, event: str = "event_id"):
    """Starts from a writer: events (``path``, ``ts``, ``present``, and ``event``, which breaks ties) as changes: added, modified or deleted
    by whether the path was known.

    An event for a path that is neither known nor present is left out.
    """
    log = Log(stream.sparkSession, f"{folder}/log", ["path"], _types(stream, ["path", "present"]))

    def step(batch: DataFrame, number: int) -> DataFrame:
        batch = batch.withColumn("present", F.coalesce("present", F.lit(False)))
        led = _led(batch, ["path"], ["ts", event], "present", log.before(number))
        log.write(number, _last(batch, ["path"], ["ts", event], ["path", "present"]))
        known = F.coalesce("before_", F.lit(False))
        change = F.when(F.col("present"), F.when(known, "modified").otherwise("added")).when(known, "deleted")
        return led.select("path", "ts", change.alias("change")).where("change is not null")

    return _in_batches(stream, folder, step)


def written(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.fieldNames())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
