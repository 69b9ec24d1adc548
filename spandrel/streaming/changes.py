"""A folder's files as a stream of changes: added, changed and deleted, at any depth.

The offset of the stream is the listing itself, (path, modified, size) of every watched file, packed into the offset log.
So a restart compares what is there now with what the last batch saw, whatever happened between; a batch that is run
again gives the same paths. Contents are read by the executors.
"""

from __future__ import annotations

import base64
import json
import os
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spandrel.functions import paths
from spandrel.sources.files import PART_BYTES, PART_FILES, walk

#: Seconds without a change before a burst is given on.
PAUSE = 0.3
CHANGES = "path string, event string, modified long, size long, content string"

Listing = dict[str, tuple[int, int]]


def listing(root: str, include: list[str], exclude: list[str]) -> Listing:
    """(modified in nanoseconds, size) of each file by relative path; a file that goes meanwhile is left out."""
    out = {}
    for path, full in walk(root):
        if paths.match(path, include) and not paths.match(path, exclude):
            try:
                held = os.stat(full)
            except FileNotFoundError:
                continue
            out[path] = (held.st_mtime_ns, held.st_size)
    return out


def packed(held: Listing) -> dict:
    text = json.dumps(sorted([p, *v] for p, v in held.items()), separators=(",", ":"))
    return {"files": len(held), "listing": base64.b64encode(zlib.compress(text.encode())).decode()}


def unpacked(offset: dict) -> Listing:
    return {p: (m, s) for p, m, s in json.loads(zlib.decompress(base64.b64decode(offset["listing"])))}


def compare(before: Listing, after: Listing) -> list[tuple[str, str, int, int]]:
    """(path, event, modified, size), by path."""
    out = [(p, "deleted", *before[p]) for p in before.keys() - after.keys()]
    out += [(p, "changed" if p in before else "added", *v) for p, v in after.items() if before.get(p) != v]
    return sorted(out)


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.rows = rows


class _Changes(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.include = [g for g in options.get("include", "**/*").split(";") if g]
        self.exclude = [g for g in options.get("exclude", "").split(";") if g]
        self.pause = float(options.get("pause", PAUSE))
        self.existing = options.get("existing", "true").lower() == "true"
        for globs in (self.include, self.exclude):
            if error := paths.glob_list_error(globs):
                raise ValueError(error)
        self.given: Listing | None = None  # what the last offset said
        self.seen: Listing | None = None  # what is there, and since when it is as it is
        self.since = 0.0

    def _now(self) -> Listing:
        return listing(self.root, self.include, self.exclude)

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        self.given = {} if self.existing else self._now()
        return packed(self.given)

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        """The listing, once it has not changed for the pause: a burst of saves is one batch, given when it is over."""
        now = self._now()
        if now != self.seen:
            self.seen, self.since = now, time.monotonic()
        if self.given is None or time.monotonic() - self.since >= self.pause:
            self.given = now
        return packed(self.given)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = compare(unpacked(start), unpacked(end))
        parts, size = [[]], 0
        for r in rows:
            if parts[-1] and (size + r[3] > PART_BYTES or len(parts[-1]) >= PART_FILES):
                parts.append([])
                size = 0
            parts[-1].append(r)
            size += r[3]
        return [_Part(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, event, modified, size in partition.rows:
            content = None
            if event != "deleted":
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                        content = f.read()
                except FileNotFoundError:  # gone since: the next offset tells
                    event = "deleted"
            yield path, event, modified, size, content

    def commit(self, end: dict) -> None:
        pass


class FileChanges(DataSource):
    """spark.readStream.format("file_changes").option("include", "**/*.py;**/*.ts").load(folder).

    Options: include and exclude, globs with ; between them; pause, seconds; existing, whether the first batch has the
    files that are there at the start.
    """

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return _Changes(dict(self.options))


def read_changes(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None, pause: float = PAUSE, existing: bool = True) -> DataFrame:
    """The stream of changes below root."""
    spark.dataSource.register(FileChanges)
    reader = spark.readStream.format("file_changes").option("include", ";".join(include)).option("exclude", ";".join(exclude or []))
    return reader.option("pause", str(pause)).option("existing", str(existing).lower()).load(root)
