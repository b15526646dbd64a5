"""Batch forms of change and revision streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.ordering import running_sum, with_previous


def debounced(changes: DataFrame, client: str, ts: str, order: list[str], gap_seconds: float) -> DataFrame:
    """Bursts of changes: ``client``, ``first_ts``, ``last_ts``, ``n_changes`` and the last row's ``order`` as ``last``.

    A change within the gap of the one before restarts the wait, so a burst ends with a quiet gap.
    """
    rows = with_previous(changes.select(client, ts, *order), [client], [ts, *order], {ts: "before_"})
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    starts = F.when(F.col("before_").isNull() | (micros(F.col(ts)) - micros(F.col("before_")) >= int(gap_seconds * 1e6)), 1).otherwise(0).cast("long")
    numbered = running_sum(rows, [client], [ts, *order], starts, "burst_")
    return numbered.groupBy(client, "burst_").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_changes"), F.max_by(F.col(order[-1]), F.struct(ts, *order)).alias("last")).drop("burst_")


def without_repeats(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from that of the row before; A, B, A keeps all three."""
    led = with_previous(rows.withColumn("has_", F.lit(True)), keys, order, {value: "before_", "has_": "seen_"})
    return led.where(F.col("seen_").isNull() | ~F.col(value).eqNullSafe(F.col("before_"))).select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a newer ref takes the slot of the one that waits."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("last_")).select("last_.*")


def gaps(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``keys``, ``after_seq``, ``next_seq``, ``n_missing``: numbers that were passed over."""
    led = with_previous(rows.select(*keys, seq), keys, [seq], {seq: "after_seq"})
    return led.where(F.col(seq) > F.col("after_seq") + 1).select(*keys, "after_seq", F.col(seq).alias("next_seq"), (F.col(seq) - F.col("after_seq") - 1).alias("n_missing"))


def retry_schedule(refs: DataFrame, failures: Column, retries: int, base_ms: int) -> DataFrame:
    """``refs`` with one row for each attempt: ``attempt`` from 1, ``at_ms`` since the first, ``outcome``.

    The wait before the next attempt is the attempt's number times ``base_ms`` and follows the last failure too.
    """
    tries = F.least(failures + 1, F.lit(retries + 1)).cast("int")
    rows = refs.withColumn("failures_", failures).withColumn("attempt", F.explode(F.sequence(F.lit(1), tries)))
    waited = (F.col("attempt") * (F.col("attempt") - 1) / 2).cast("long") * base_ms
    outcome = F.when(F.col("attempt") > F.col("failures_"), "done").when(F.col("attempt") == retries + 1, "exhausted").otherwise("retry")
    return rows.select(*refs.columns, "attempt", waited.alias("at_ms"), outcome.alias("outcome"))


def recovery_schedule(refs: DataFrame, failed_rounds: Column, retries: int, base_ms: int, most: int = 10) -> DataFrame:
    """``refs`` with one row for each time they are queued again after all attempts failed: ``recovery``, ``delay_ms``, ``state``.

    After ``most`` times a ref is given up and forgotten, so that it is taken when it is sent anew; 0 never queues again.
    """
    again = F.least(failed_rounds, F.lit(most)).cast("int")
    rows = refs.withColumn("rounds_", failed_rounds).withColumn("recovery", F.explode(F.sequence(F.lit(0), again)))
    state = F.when(F.col("recovery") == F.col("rounds_"), "done").when(F.col("recovery") == most, "invalidated").otherwise("queued")
    delay = F.when(state == "queued", F.lit(base_ms * (retries + 1))).otherwise(0)
    return rows.select(*refs.columns, "recovery", delay.cast("long").alias("delay_ms"), state.alias("state"))


def multicast(messages: DataFrame, clients: DataFrame, group: str, origin: str, client: str) -> DataFrame:
    """Every message to each client of its group but the one it came from."""
    return messages.join(clients, group).where(~F.col(origin).eqNullSafe(F.col(client)))


def decisions(refs: DataFrame) -> DataFrame:
    """What a receiver does with a ref: ``equal``, ``relation`` (null: not classified) give ``action``."""
    action = F.when(F.col("equal"), "stop").when(F.col("relation") == "ahead", "ignore").when(F.col("relation") == "diverged", "merge").otherwise("restore")
    return refs.withColumn("action", action)
