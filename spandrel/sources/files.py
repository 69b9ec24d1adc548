"""Source and documentation files as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spandrel.functions import paths
from spandrel.schemas import SOURCE_FILE

#: Bounds of a scoped scan; beyond one the scan fails, it never leaves files out. Other scans have none. Fixed values.
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES = 10_000, 32 << 20, 4 << 20

#: Bytes and files of a partition of a scan.
PART_BYTES, PART_FILES = 16 << 20, 5000


def walk(root: str) -> Iterator[tuple[str, str]]:
    """(relative path, absolute path) of all regular files below root; no links are followed, .git is left out."""
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f != ".git" and not os.path.islink(os.path.join(folder, f)))
        for name in sorted(names):
            full = os.path.join(folder, name)
            if not os.path.islink(full) and os.path.isfile(full):
                yield os.path.relpath(full, root).replace(os.sep, "/"), full


def list_files(root: str, include: list[str], exclude: list[str] | None = None) -> list[str]:
    """Sorted relative paths that match an include glob and no exclude glob."""
    return sorted({p for p, _ in walk(root) if paths.match(p, include) and not paths.match(p, exclude or [])})


class _Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.include = [g for g in options.get("include", "**/*").split(";") if g]
        self.exclude = [g for g in options.get("exclude", "").split(";") if g]
        self.parts = int(options.get("parts", "0"))
        self.scoped = options.get("scoped", "false").lower() == "true"
        for globs in (self.include, self.exclude):
            if error := paths.glob_list_error(globs):
                raise ValueError(error)

    def partitions(self) -> list[InputPartition]:
        names = list_files(self.root, self.include, self.exclude)
        sizes = [os.path.getsize(os.path.join(self.root, n)) for n in names]
        if self.scoped and len(names) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files")
        if self.scoped and (sum(sizes) > MOST_BYTES or max(sizes, default=0) > MOST_FILE_BYTES):
            raise ValueError("the files are too large")
        parts = self.parts or max(8, -(-sum(sizes) // PART_BYTES), -(-len(names) // PART_FILES))
        return [_Part(names[i::parts]) for i in range(min(parts, len(names)))] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for name in partition.names:
            with open(os.path.join(self.root, name), encoding="utf-8", errors="replace") as f:
                yield name, f.read()


class SourceFiles(DataSource):
    """spark.read.format("source_files").option("include", "src/**/*.py;*.ts").load(folder): path, content.

    Unlike Spark's own file sources it reads names that begin with _ or a dot where a glob asks for them.
    """

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self):
        return SOURCE_FILE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_sources(spark: SparkSession, root: str, include: list[str], exclude: list[str] | None = None, scoped: bool = False) -> DataFrame:
    """path and content of all files that match; a scoped scan fails beyond its bounds."""
    spark.dataSource.register(SourceFiles)
    return spark.read.format("source_files").option("include", ";".join(include)).option("exclude", ";".join(exclude or [])).option("scoped", str(scoped).lower()).load(root)


def captured(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Files that are already in memory."""
    return spark.createDataFrame(sorted(rows), SOURCE_FILE)


def read_documentation(spark: SparkSession, root: str, output_dir: str = "docs", exclude: list[str] | None = None) -> DataFrame:
    """README.md, CHANGELOG.md and all Markdown files below docs and the output folder."""
    folders = sorted({"docs", output_dir.strip("/")})
    return read_sources(spark, root, ["README.md", "CHANGELOG.md", *(f"{d}/**/*.md" for d in folders)], exclude)


def within_limits(files: DataFrame) -> DataFrame:
    """files (path, content) as they are; the job fails if they are too many or too large."""
    size = F.octet_length("content")
    checked = files.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("all"), F.max(size).alias("most"))
    bad = (F.col("n") > MOST_FILES) | (F.col("all") > MOST_BYTES) | (F.col("most") > MOST_FILE_BYTES)
    one = checked.select(F.when(bad, F.raise_error(F.lit("the files are too many or too large")).cast("boolean")).otherwise(F.lit(True)).alias("ok"))
    return files.crossJoin(F.broadcast(one)).where("ok").drop("ok")  # one row


def project_info(package_json: DataFrame) -> DataFrame:
    """One row (name, description, dependencies) of package.json rows (content)."""
    kind = "name string, description string, dependencies map<string,string>, devDependencies map<string,string>"
    held = package_json.select(F.from_json("content", kind).alias("p"))
    names = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    return held.select(F.coalesce("p.name", F.lit("project")).alias("name"), F.coalesce("p.description", F.lit("")).alias("description"), F.array_sort(F.array_distinct(F.concat(names("p.dependencies"), names("p.devDependencies")))).alias("dependencies"))
