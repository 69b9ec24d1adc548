"""An ordered table of lines as files: parts in order and a manifest that makes them count.

spark.write.format("ordered_lines").save(folder) writes the one string column of a table. Each task writes a part under a
name of its own, and what it says on success goes into the manifest, which appears in one step when all parts are there;
parts of failed attempts are in no manifest, and an aborted write leaves nothing that a reader would see.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    lines: int
    size: int
    sha256: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{self.job}-{uuid.uuid4().hex[:8]}.jsonl"
        count, size, digest = 0, 0, hashlib.sha256()
        with open(os.path.join(self.folder, name), "wb") as f:
            for row in iterator:
                line = row[0].encode() + b"\n"
                f.write(line)
                digest.update(line)
                count, size = count + 1, size + len(line)
            f.flush()
            os.fsync(f.fileno())
        return _Written(part, name, count, size, digest.hexdigest())

    def commit(self, messages: list) -> None:
        manifest = os.path.join(self.folder, MANIFEST)
        if os.path.exists(manifest) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError("the folder holds a table")
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        held = {"lines": sum(p.lines for p in parts), "parts": [{"lines": p.lines, "name": p.name, "sha256": p.sha256, "size": p.size} for p in parts if p.lines]}
        draft = f"{manifest}.{self.job}"
        os.makedirs(self.folder, exist_ok=True)
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(held, f, sort_keys=True, separators=(",", ":"))
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, manifest)
        keep = {p["name"] for p in held["parts"]}
        for name in os.listdir(self.folder):  # an older table's, and those of attempts that failed
            if name.startswith("part-") and name not in keep:
                os.remove(os.path.join(self.folder, name))

    def abort(self, messages: list) -> None:
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if name.startswith("part-") and f"-{self.job}-" in name:
                    os.remove(os.path.join(self.folder, name))


class _Part(InputPartition):
    def __init__(self, place: int, part: dict):
        self.place, self.part = place, part


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        with open(os.path.join(self.folder, MANIFEST), encoding="utf-8") as f:
            held = json.load(f)
        before = 0
        out = []
        for p in held["parts"]:
            out.append(_Part(before, p))
            before += p["lines"]
        return out or [_Part(0, {"name": None})]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.part["name"] is None:
            return
        digest = hashlib.sha256()
        with open(os.path.join(self.folder, partition.part["name"]), "rb") as f:
            for k, line in enumerate(f):
                digest.update(line)
                yield partition.place + k + 1, line[:-1].decode()
        if digest.hexdigest() != partition.part["sha256"]:
            raise ValueError("a part is not what the manifest says")


class OrderedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "position long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(_local(self.options["path"]), overwrite)


def write(df: DataFrame, line: str, order: list, folder: str, overwrite: bool = False) -> None:
    """Write a string column in the order of the given columns; as many parts as the session shuffles to."""
    spark = df.sparkSession
    spark.dataSource.register(OrderedLines)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(F.col(line).alias("line")).write.format("ordered_lines").mode("overwrite" if overwrite else "append").save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """position (from 1) and line of each line; a part that is not what was written is an error."""
    spark.dataSource.register(OrderedLines)
    return spark.read.format("ordered_lines").load(folder)
