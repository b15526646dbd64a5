"""A directory as a streaming source: each micro-batch is what differs between two snapshots of it.

``spark.readStream.format("sylva_directory_changes")`` with the options ``path``, ``state`` (a folder that all executors and
the driver see, for the snapshots), ``ignore``, ``content`` (whether files are compared by content, or by size and time of
change alone), ``slices`` and ``splitDepth``.

An offset is a snapshot's number.  To plan a batch the driver only takes the next number; the executors list the
directory, each its slice, and write the listing before any change is given out, under a name that the first writer
wins.  A batch that is repeated after a failure therefore reads the listing that it made and gives the same changes, and
what changed meanwhile is in the next one: no change is lost, and none is given twice to a sink that knows its batches.
Snapshots older than the last committed one are removed.

Every batch lists the whole directory, so a change that no notice was given of (drift) is found as well.  Down to
``splitDepth`` directories the names fall to slices by a hash; what lies below is dealt by its directory at that depth, so
neither a flat directory nor a deep one is a single task.  A directory of many names that all slices need is
listed by the first of them, which leaves each slice's names with the snapshot; slices begin at different directories,
so they share this work.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from stat import S_ISREG

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sylva.functions import paths
from sylva.operators.ordering import mounted
from sylva.sources.directory import ScanError, content_hash

SCHEMA = "step long, ts timestamp, path string, change string"
SLICES, SPLIT_DEPTH = 32, 2
#: Names of a directory that every slice may list for itself.
FEW = 1_000


@dataclass
class Slice(InputPartition):
    """Part ``number`` of the difference of two snapshots."""

    start: int
    end: int
    number: int


class Snapshots:
    """Listings of a directory by number and slice, in the folder ``state``."""

    def __init__(self, state: str):
        self.state = mounted(state)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.state) if n.isdigit()) if os.path.isdir(self.state) else []

    def new(self) -> int:
        """The next number; a folder is made for it, so no other reader gets the same one."""
        os.makedirs(self.state, exist_ok=True)
        number = max(self.numbers(), default=0)
        while True:
            number += 1
            try:
                os.mkdir(os.path.join(self.state, str(number)))
                return number
            except FileExistsError:
                continue

    def _file(self, number: int, part: int) -> str:
        return os.path.join(self.state, str(number), f"{part}.json")

    def read(self, number: int, part: int) -> dict[str, str] | None:
        """``path`` to what tells its content, of one slice; None if it isn't written.  Snapshot 0 is empty."""
        if number == 0:
            return {}
        try:
            with open(self._file(number, part)) as f:
                return dict(json.loads(line) for line in f)
        except FileNotFoundError:
            return None

    def write(self, number: int, part: int, listing: Iterator[tuple[str, str]]) -> None:
        """Writes a listing unless there is one: of two tasks that write the same slice the first wins."""
        target = self._file(number, part)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        temporary = f"{target}.{uuid.uuid4().hex}"
        try:
            with open(temporary, "w") as f:
                for row in listing:
                    f.write(json.dumps(row) + "\n")
            os.link(temporary, target)
        except FileExistsError:
            pass
        finally:
            if os.path.exists(temporary):
                os.remove(temporary)

    def names(self, number: int, directory: str, slices: int, part: int, listed: Iterator[tuple[int, str, str]]) -> tuple[list[tuple[str, str]], list[str]]:
        """Of a ``directory``, the names (with their kinds) that fall to a slice, and all directories.

        ``listed`` (slice, name, kind) is asked by whoever comes first, and what it says of many names is kept with the
        snapshot for the other slices; of two that list a directory at once the first to end wins.
        """
        folder = os.path.join(self.state, str(number), f"names-{hashlib.blake2b(directory.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}")
        if not os.path.isdir(folder):
            few = list(islice(listed, FEW + 1))
            if len(few) <= FEW:
                return [n[1:] for n in few if n[0] == part], [n[1] for n in few if n[2] == "directory"]
            temporary = f"{folder}.{uuid.uuid4().hex}"
            os.makedirs(temporary)
            try:
                with contextlib.ExitStack() as files:
                    to = {k: files.enter_context(open(os.path.join(temporary, str(k)), "w")) for k in ("dirs", *range(slices))}
                    for k, name, kind in chain(few, listed):
                        to[k].write(json.dumps([name, kind]) + "\n")
                        if kind == "directory":
                            to["dirs"].write(json.dumps(name) + "\n")
                os.rename(temporary, folder)
            except OSError:
                shutil.rmtree(temporary, ignore_errors=True)
                if not os.path.isdir(folder):
                    raise
        with open(os.path.join(folder, str(part))) as own, open(os.path.join(folder, "dirs")) as dirs:
            return [tuple(json.loads(line)) for line in own], [json.loads(line) for line in dirs]

    def drop_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                shutil.rmtree(os.path.join(self.state, str(n)), ignore_errors=True)


def _slice_of(path: str, slices: int) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % slices


class DirectoryChanges(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = mounted(options["path"])
        self.snapshots = Snapshots(options["state"])
        self.ignore = tuple(x for x in options.get("ignore", ",".join(paths.DEFAULT_IGNORE)).split(",") if x)
        self.content = str(options.get("content", "true")).lower() == "true"
        self.slices, self.split_depth = int(options.get("slices", SLICES)), int(options.get("splitDepth", SPLIT_DEPTH))

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        return {"snapshot": self.snapshots.new()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise ScanError(f"not a directory: {self.root}")
        return [Slice(start["snapshot"], end["snapshot"], k) for k in range(self.slices)]

    def commit(self, end: dict) -> None:
        self.snapshots.drop_before(end["snapshot"])

    def read(self, partition: Slice) -> Iterator[tuple]:
        from datetime import UTC, datetime

        before = self.snapshots.read(partition.start, partition.number)
        if before is None:
            raise ScanError(f"snapshot {partition.start} is gone from {self.snapshots.state}")
        now = self.snapshots.read(partition.end, partition.number)
        if now is None:
            self.snapshots.write(partition.end, partition.number, self.listing(partition.number, partition.end))
            now = self.snapshots.read(partition.end, partition.number) or {}
        at = datetime.now(UTC).replace(tzinfo=None)
        for path, told in now.items():
            if path not in before or before[path] != told:
                yield partition.end, at, path, "modified" if path in before else "added"
        for path in before:
            if path not in now:
                yield partition.end, at, path, "deleted"

    def listing(self, number: int, snapshot: int) -> Iterator[tuple[str, str]]:
        """The entries of a slice of a ``snapshot`` and what tells their content."""
        waiting = [("", 1)]
        while waiting:
            above, depth = waiting.pop(0)
            own, dirs = self.snapshots.names(snapshot, above, self.slices, number, self._dealt(above))
            for name, kind in own:
                path = above + name
                if kind == "directory":
                    yield path, paths.DIR_MARKER
                    if depth >= self.split_depth:
                        yield from self._below(path)
                else:
                    yield from self._told(path)
            if depth < self.split_depth:
                below = sorted(f"{above}{name}/" for name in dirs)
                first = len(below) * number // self.slices  # slices begin at different ones
                waiting += [(d, depth + 1) for d in below[first:] + below[:first]]

    def _dealt(self, above: str) -> Iterator[tuple[int, str, str]]:
        for name, kind in self._names(above):
            yield _slice_of(above + name, self.slices), name, kind

    def _names(self, above: str) -> Iterator[tuple[str, str]]:
        try:
            with os.scandir(os.path.join(self.root, above)) as entries:
                for e in entries:
                    if e.name.startswith(self.ignore) or e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        yield e.name, "directory"
                    elif e.is_file(follow_symlinks=False):
                        yield e.name, "file"
        except (FileNotFoundError, NotADirectoryError):  # gone since it was listed: told by what isn't there
            return

    def _below(self, directory: str) -> Iterator[tuple[str, str]]:
        """The whole subtree of a directory that belongs to the slice."""
        dirs = []
        for name, kind in self._names(f"{directory}/"):
            path = f"{directory}/{name}"
            if kind == "directory":
                yield path, paths.DIR_MARKER
                dirs.append(path)
            else:
                yield from self._told(path)
        for path in dirs:
            yield from self._below(path)

    def _told(self, path: str) -> Iterator[tuple[str, str]]:
        full = os.path.join(self.root, path)
        try:
            stat = os.lstat(full)
            # what has become something else since it was listed is in the next snapshot
            if S_ISREG(stat.st_mode):
                yield path, content_hash(full) if self.content else f"{stat.st_size}/{stat.st_mtime_ns}"
        except (FileNotFoundError, NotADirectoryError):
            return


class DirectoryChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sylva_directory_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DirectoryChanges:
        return DirectoryChanges(self.options)


def changes(spark: SparkSession, root: str, state: str, ignore: tuple[str, ...] = paths.DEFAULT_IGNORE, content: bool = True, slices: int = SLICES) -> DataFrame:
    """The changes of a directory as a stream; its first batch has all entries, as added."""
    spark.dataSource.register(DirectoryChangesSource)
    reader = spark.readStream.format("sylva_directory_changes").option("path", str(root)).option("state", str(state))
    return reader.option("ignore", ",".join((*paths.SYNC_IGNORE, *ignore))).option("content", str(content).lower()).option("slices", str(slices)).load()
