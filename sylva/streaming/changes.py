"""Change streams: debouncing by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(changes: DataFrame, client: str = "client", ts: str = "ts", last: str = "event_id", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Bursts of changes of each client; a burst is given out once the watermark has passed its quiet gap."""
    found = changes.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("burst"), client)
    summed = found.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_changes"), F.max_by(last, F.struct(ts, last)).alias("last"))
    return summed.drop("burst")
