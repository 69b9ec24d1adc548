"""A revision of a repository as a partitioned table.

spark.read.format("git_tree").option("revision", "HEAD").load(clone) has a row for each file: path, mode, oid, size and
content. The driver lists folders only as far as it takes to have enough of them; each partition lists its own subtrees
and reads its own files. Filters on path (equal, in, begins with) cut the subtrees that are listed at all, those on path
and size the files whose contents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from spandrel.sources import git

SCHEMA = "path string, mode string, oid string, size long, content string"
#: Folders that make a partition each; files of the folders above them are a partition of their own.
PARTS = 64
#: Bytes of contents that one git process is asked for.
ASKED_BYTES = 16 << 20


def _entries(root: str, commit: str, folder: str, deep: bool) -> list[tuple[str, str, str, str, int]]:
    """(path, kind, mode, oid, size) of a folder's entries, of all files below it if deep."""
    args = ["ls-tree", "-z", "-l", "--full-tree", *(["-r"] if deep else []), commit]
    out = []
    for line in git.run(root, *args, *([f"{folder}/"] if folder else [])).split("\0"):
        if line:
            head, path = line.split("\t", 1)
            mode, kind, oid, size = head.split()
            out.append((path, kind, mode, oid, int(size) if size.isdigit() else 0))
    return out


class _Part(InputPartition):
    """Folders to list in full, or files that are known already."""

    def __init__(self, folders: list[str], files: list[tuple]):
        self.folders, self.files = folders, files


class Pushed:
    """The filters that the source applies itself."""

    def __init__(self):
        self.exact: set[str] | None = None
        self.starts: list[str] = []
        self.ends: list[str] = []
        self.least, self.most = 0, 1 << 62

    def take(self, f: Filter) -> bool:
        column = getattr(f, "attribute", ())
        if column == ("path",):
            if isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.exact = names if self.exact is None else self.exact & names
            elif isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith):
                self.ends.append(f.value)
            else:
                return False
            return True
        if column == ("size",) and isinstance(getattr(f, "value", None), int):
            if isinstance(f, (LessThan, LessThanOrEqual)):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            else:
                return False
            return True
        return False

    def may_hold(self, folder: str) -> bool:
        """Whether a file that is asked for can be below the folder."""
        inside = folder + "/" if folder else ""
        begins = all(s.startswith(inside) or inside.startswith(s) for s in self.starts)
        return begins and (self.exact is None or any(n.startswith(inside) for n in self.exact))

    def keeps(self, path: str, size: int) -> bool:
        return (self.exact is None or path in self.exact) and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends)) and self.least <= size <= self.most


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        asked = options.get("revision", "HEAD")
        self.commit = git.resolve(self.root, asked)
        if self.commit is None:
            raise ValueError("the revision cannot be resolved")
        self.parts = int(options.get("parts", PARTS))
        self.contents = options.get("contents", "true").lower() == "true"
        self.pushed = Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if not self.pushed.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        folders, files = [""], []
        while folders and len(folders) < self.parts:  # a level deeper each time
            below = []
            for folder in folders:
                for path, kind, *rest in _entries(self.root, self.commit, folder, deep=False):
                    if kind == "tree" and self.pushed.may_hold(path):
                        below.append(path)
                    elif kind == "blob" and self.pushed.keeps(path, rest[2]):
                        files.append((path, *rest))
            folders = below
        loose = [_Part([], files[i : i + git.ASKED]) for i in range(0, len(files), git.ASKED)]
        return [*([_Part([f], []) for f in folders]), *loose] or [_Part([], [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        held = list(partition.files)
        for folder in partition.folders:
            held += [(p, *rest) for p, kind, *rest in _entries(self.root, self.commit, folder, deep=True) if kind == "blob" and self.pushed.keeps(p, rest[2])]
        if not self.contents:
            for path, mode, oid, size in held:
                yield path, mode, oid, size, None
            return
        at = 0
        while at < len(held):
            end, asked = at, 0
            while end < len(held) and (end == at or (asked + held[end][3] <= ASKED_BYTES and end - at < git.ASKED)):
                asked += held[end][3]
                end += 1
            for row, text in zip(held[at:end], git.objects(self.root, [r[2] for r in held[at:end]]), strict=True):
                yield *row, text
            at = end


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, root: str, revision: str = "HEAD", contents: bool = True, parts: int = PARTS) -> DataFrame:
    """All files of a revision; where() on path and size is pushed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").option("revision", revision).option("contents", str(contents).lower()).option("parts", str(parts)).load(root)


def compare_trees(before: DataFrame, after: DataFrame) -> DataFrame:
    """FILE_CHANGE without contents of two tables of read_tree(): one full outer join on the path, and renames of files
    that are the same object, the n-th gone with the n-th new. What is alike but not equal is gone and new."""
    from pyspark.sql import Window

    b, a = (df.select("path", "oid", "mode").alias(n) for df, n in ((before, "b"), (after, "a")))
    both = b.join(a, F.col("b.path") == F.col("a.path"), "full_outer")
    same = both.where("b.path is not null and a.path is not null and (b.oid <> a.oid or b.mode <> a.mode)").select(F.lit("modified").alias("status"), F.col("b.path").alias("before_path"), F.col("a.path").alias("after_path"))
    end = lambda side, other: both.where(f"{other}.path is null").select(F.col(f"{side}.oid").alias("oid"), F.col(f"{side}.path").alias(f"{side}_path"))
    place = lambda df, c: df.withColumn("n", F.row_number().over(Window.partitionBy("oid").orderBy(c)))
    moved = place(end("b", "a"), "b_path").join(place(end("a", "b"), "a_path"), ["oid", "n"], "full_outer")
    status = F.when(F.col("b_path").isNull(), "added").when(F.col("a_path").isNull(), "deleted").otherwise("renamed")
    return same.union(moved.select(status.alias("status"), F.col("b_path").alias("before_path"), F.col("a_path").alias("after_path")))
