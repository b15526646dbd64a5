"""Slash-separated relative paths; ``.`` is the root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "."
DIR_MARKER = "<dir>"
#: Names that a scan leaves out unless told otherwise; each is a prefix.
DEFAULT_IGNORE = ("node_modules", ".git", "dist", "coverage")
#: Names that a sync always leaves out.
SYNC_IGNORE = (".sync-errors.log", ".sylva-tmp-")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The directory of a path; the root's own parent is null."""
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(path == ROOT, F.lit(None)).when(cut == "", F.lit(ROOT)).otherwise(cut)


def depth(path: Column) -> Column:
    """0 for the root, else the number of segments."""
    return F.when(path == ROOT, 0).otherwise(F.size(F.split(path, "/", -1)))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root first."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    return F.when(path == ROOT, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit(ROOT)), above))


def extension(path: Column) -> Column:
    """From the last dot of the name, unless that is its first character; empty without one."""
    return F.regexp_extract(basename(path), r"(?s)^.+?([.][^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.left(name, F.length(name) - F.length(extension(path)))


def directory_prefix(path: Column) -> Column:
    """Everything up to and with the last slash."""
    return F.left(path, F.length(path) - F.length(basename(path)))


def any_segment_ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a segment starts with a pattern: an ignored directory takes its subtree along."""
    if not patterns:
        return F.lit(False)
    return F.exists(F.split(path, "/", -1), lambda s: _starts(s, patterns))


def event_ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Change events are held against the start of the whole path only."""
    return _starts(path, patterns) if patterns else F.lit(False)


def _starts(value: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.startswith(value, F.lit(p))
    return found


def conflict_time(ms: Column) -> Column:
    """``YYYY-MM-DD HHMMSS`` in UTC, whatever the session's zone."""
    seconds = F.floor(ms / 1000)
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")
    return F.concat(date, F.lit(" "), two(F.floor(rest / 3600)), two(F.floor(rest % 3600 / 60)), two(rest % 60))


def conflict_name(path: Column, client: Column, ms: Column, number: Column | None = None) -> Column:
    """``dir/stem (conflicted copy CLIENT TIME).ext``; ``number`` from 1 adds `` (number)`` before the extension."""
    suffix = F.lit("") if number is None else F.when(number > 0, F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(directory_prefix(path), stem(path), F.lit(" (conflicted copy "), client, F.lit(" "), conflict_time(ms), F.lit(")"), suffix, extension(path))
