"""Streams with keyed state and timers: the latest row of a key once it is quiet.

Rows of a key are taken one by one and never gathered, so a key with any number of rows in a micro-batch needs no more
memory than its open bursts.  State is kept by RocksDB (:func:`stateful`), outside the workers' memory and in the
query's checkpoint.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Sets the state store that processors of this module need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class Bursts:
    """Bursts of moments, each with its greatest row; moments within ``gap`` of each other are of one burst."""

    def __init__(self, gap: int, open_: list[tuple[int, int, tuple]] = ()):
        self.gap, self.open = gap, sorted(open_)

    def add(self, at: int, row: tuple) -> None:
        """``row`` compares by its first element."""
        first, last = at, at
        k = bisect_left(self.open, (at, at))
        while k and self.open[k - 1][1] + self.gap > at:
            k -= 1
        n = k
        while n < len(self.open) and self.open[n][0] < last + self.gap:
            first, last = min(first, self.open[n][0]), max(last, self.open[n][1])
            row = max(row, self.open[n][2], key=lambda r: r[0])
            n += 1
        self.open[k:n] = [(first, last, row)]

    def quiet(self, now: int) -> list[tuple[int, int, tuple]]:
        """Takes out the bursts whose quiet gap has passed."""
        done = [b for b in self.open if b[1] + self.gap <= now]
        self.open = [b for b in self.open if b[1] + self.gap > now]
        return done


class Latest(StatefulProcessor):
    """Gives the latest row of each burst of a key once its quiet gap has passed, by event time or by the clock."""

    def __init__(self, gap_ms: int, ts: str, order: tuple[str, ...], schema: T.StructType, by_clock: bool):
        self.gap, self.ts, self.order, self.schema, self.by_clock = gap_ms, ts, order, schema, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("first_ms_", T.LongType()), T.StructField("last_ms_", T.LongType()), *self.schema.fields]
        self.state = handle.getListState("bursts", T.StructType(fields))

    def _held(self) -> Bursts:
        return Bursts(self.gap, [(s[0], s[1], self._row(tuple(s)[2:])) for s in self.state.get()] if self.state.exists() else [])

    def _row(self, values: tuple) -> tuple:
        at = {f.name: v for f, v in zip(self.schema.fields, values)}
        # null is less than any value
        return tuple((at[c] is not None, at[c]) if at[c] is not None else (False, 0) for c in (self.ts, *self.order)), values

    def _keep(self, bursts: Bursts) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if bursts.open:
            self.state.put([(first, last, *row[1]) for first, last, row in bursts.open])
            self.handle.registerTimer(min(b[1] for b in bursts.open) + self.gap)
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bursts = self._held()
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else None
        for row in rows:
            values = tuple(row[f.name] for f in self.schema.fields)
            bursts.add(now if self.by_clock else int(row["ms_"]), self._row(values))
        self._keep(bursts)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that are quiet by now: a timer in the past would wait for the next batch
        bursts, now = self._held(), timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        for _, _, row in bursts.quiet(max(now, expiredTimerInfo.getExpiryTimeInMs())):
            yield Row(**{f.name: v for f, v in zip(self.schema.fields, row[1])})
        self._keep(bursts)

    def close(self) -> None:
        pass


def latest_when_quiet(rows: DataFrame, keys: list[str], ts: str, order: list[str], gap: str = "300 milliseconds", late: str | None = None) -> DataFrame:
    """The latest row (by ``ts``, then ``order``) of each burst of a key, once the key has been quiet for ``gap``.

    A newer row takes the slot of the one that waits and starts the wait anew.  With ``late``, times are those of ``ts``, of
    which rows may be late by so much; without, those of the clock when a row arrives.
    """
    stateful(rows.sparkSession)
    gap_ms = rows.sparkSession.range(1).select((F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {gap}")) - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))).alias("us")).first()["us"] // 1000
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    if late is None:
        return rows.groupBy(*keys).transformWithState(Latest(gap_ms, ts, tuple(order), schema, True), schema, "append", "ProcessingTime")
    timed = rows.withColumn("ms_", F.floor(F.unix_micros(ts) / 1000)).withWatermark(ts, late)
    return timed.groupBy(*keys).transformWithState(Latest(gap_ms, ts, tuple(order), schema, False), schema, "append", "EventTime")
