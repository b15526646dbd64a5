"""Content hashes.  Sets are hashed by sums of their members' hashes, which Spark adds up before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a lane; four lanes cover 60 of a SHA-256's 64 digits.
_LANE, _LANES = 15, 4


def fields_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each behind its length in characters; null is unlike any text."""
    parts = [F.coalesce(F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def set_lanes(member: Column) -> list[Column]:
    """Aggregates that add up the lanes of hexadecimal hashes; equal multisets have equal sums in any order."""
    digits = [F.conv(F.substring(member, 1 + k * _LANE, _LANE), 16, 10).cast("decimal(38,0)") for k in range(_LANES)]
    return [F.coalesce(F.sum(d), F.lit(0)).cast("decimal(38,0)").alias(f"lane{k}") for k, d in enumerate(digits)]


def set_hash(*leading: Column) -> Column:
    """The hash of ``leading`` fields and of the sums of :func:`set_lanes`."""
    return fields_hash(*leading, *(F.col(f"lane{k}") for k in range(_LANES)))
