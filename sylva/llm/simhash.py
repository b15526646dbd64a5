"""SimHash fingerprints as one grouped sum over exploded word shingles.

The 64 votes of a text are kept in 32 longs: lane ``j`` adds bit ``j`` in its low half and bit ``j + 32``
in its high half, so one masked shift per lane counts two bits.  A text would need 2**32 shingles to
overflow a half, more than a string can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the separators of a word.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 32
_LANE_MASK = 0x0000000100000001


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale or script."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def bit_count_between(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit fingerprints."""
    return 1.0 - bit_count_between(a, b) / F.lit(64.0)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def simhash(rows: DataFrame, keys: list[str], words: str, shingle_words: int, keep: dict[str, Column] | None = None) -> DataFrame:
    """``keys`` + ``fingerprint`` long + ``copies`` long, one row for each different ``keys``.

    ``words`` names an array<string> column; a row of fewer words than ``shingle_words`` has its whole
    sequence as its only shingle, a row of none has fingerprint zero.  Shingles vote once for each time they
    occur (term-frequency weights) with their XXH64, seed 42; a bit is set if over half the votes set it.
    ``copies`` counts the rows that share ``keys``: rows of equal keys must have equal words, so their summed
    votes have the majority of each of them.  ``keep`` are further aggregates carried along.
    """
    n = F.size(words)
    at = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.greatest(n - shingle_words, F.lit(0)))))
    parts = [F.get(F.col(words), F.col("_at") + k) for k in range(shingle_words)]
    voting = F.size(words) > 0
    at = at.select(*keys, *(keep or {}), "_at", F.when(voting, F.xxhash64(F.concat_ws(" ", *parts))).alias("_h"))
    lane = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(_LANE_MASK))).alias(f"_v{j}") for j in range(LANES)]
    votes = at.groupBy(*keys).agg(
        F.count("_h").alias("_n"), F.sum(F.when(F.col("_at") == 0, 1).otherwise(0)).alias("copies"), *lane, *(f.alias(k) for k, f in (keep or {}).items())
    )
    low = [F.when(F.col(f"_v{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("_n"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(LANES)]
    high = [F.when(F.shiftrightunsigned(f"_v{j}", 32) * 2 > F.col("_n"), F.lit(_signed(1 << (j + 32)))).otherwise(F.lit(0)) for j in range(LANES)]
    bits = low[0].cast("long")
    for b in low[1:] + high:
        bits = bits.bitwiseOR(b.cast("long"))
    return votes.select(*keys, F.coalesce(bits, F.lit(0)).cast("long").alias("fingerprint"), "copies", *(keep or {}))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
