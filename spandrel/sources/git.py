"""Revisions of a repository as tables.

git lists commits and changes on the driver; contents are read by the executors, a process for many files, so the
clone must be where they can read it too.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions import paths
from spandrel.schemas import COMMIT, FILE_CHANGE, FILE_STATUS

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
#: Where a base is looked for, in order. Fixed values.
BASES = ("origin/HEAD", "origin/main", "main", "origin/master", "master", "HEAD~1")
_STATUS = {"A": "added", "M": "modified", "D": "deleted", "T": "modified"}


def run(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60, check=False)
    if done.returncode:
        raise RuntimeError("git failed")
    return done.stdout.decode("utf-8", "replace")


def _safe(*refs: str) -> None:
    for ref in refs:
        if error := paths.ref_error(ref):
            raise ValueError(error)


def resolve(root: str, ref: str) -> str | None:
    _safe(ref)
    try:
        return run(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").strip()
    except RuntimeError:
        return None


def repository_root(root: str) -> str:
    """The folder of the work tree that holds root."""
    return run(root, "rev-parse", "--show-toplevel").strip()


def is_shallow(root: str) -> bool:
    return run(root, "rev-parse", "--is-shallow-repository").strip() == "true"


class ShallowHistory(RuntimeError):
    """A base is needed that a shallow clone does not have."""


def discover_base(root: str, head: str = "HEAD") -> str:
    """The first of BASES that resolves; the empty tree for a first commit, an error in a shallow clone."""
    found = next((c for c in (resolve(root, b) for b in BASES) if c), None)
    if found is None and is_shallow(root):
        raise ShallowHistory("the base is not in this shallow clone")
    return found or EMPTY_TREE


def commits(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """hash (7 characters), message, date, author, and position from the newest."""
    _safe(base, head)
    out = run(root, "log", "-z", "--format=%H%x1f%s%x1f%aI%x1f%an", f"{base}..{head}")
    rows = [tuple(r.split("\x1f")) for r in out.split("\0") if r]
    return spark.createDataFrame([(h[:7], m, d, a, i) for i, (h, m, d, a) in enumerate(rows)], T.StructType([*COMMIT.fields, T.StructField("position", T.IntegerType())]))


def parse_status(raw: str) -> list[tuple[str, str | None, str | None]]:
    """(status, before path, after path) of a NUL-terminated name-status list; renames have two paths."""
    if raw and not raw.endswith("\0"):
        raise ValueError("the list is cut off")
    tokens = iter(raw.split("\0")[:-1])
    out: list[tuple[str, str | None, str | None]] = []
    for code in tokens:
        try:
            first = next(tokens)
            if code[:1] == "R":
                out.append(("renamed", first, next(tokens)))
            elif code in _STATUS:
                status = _STATUS[code]
                out.append((status, None if status == "added" else first, None if status == "deleted" else first))
            else:
                raise ValueError("an unknown status")
        except StopIteration:
            raise ValueError("a path is missing") from None
    return out


def changed_files(spark: SparkSession, root: str, base: str, head: str | None = "HEAD", directory: str = "") -> DataFrame:
    """status, before_path, after_path between two commits, or with head None between one and the work tree.

    In a directory each end of a rename counts by itself: the old path is deleted, the new one added.
    """
    _safe(base, *([head] if head else []))
    if head:
        rows = parse_status(run(root, "diff-tree", "-r", "-z", "-M", "--name-status", "--no-commit-id", base, head))
    else:
        rows = parse_status(run(root, "diff", "-z", "-M", "--name-status", base))
        others = run(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0")
        rows += [("added", None, p) for p in others if p]
    if directory:
        rows = [r for status, old, new in rows for r in ([("deleted", old, None), ("added", None, new)] if status == "renamed" else [(status, old, new)])]
    held = spark.createDataFrame(rows, FILE_STATUS)
    inside = paths.is_within(F.lit(directory), F.coalesce("after_path", "before_path"))
    return held.where(inside)


def diff_text(root: str, base: str, head: str) -> str:
    _safe(base, head)
    return run(root, "diff", f"{base}..{head}")


def latest_tag(root: str) -> str | None:
    try:
        return run(root, "describe", "--tags", "--abbrev=0").strip() or None
    except RuntimeError:
        return None


def _work_file(root: str, path: str) -> str | None:
    from pathlib import Path

    full = Path(root, path)
    if full.is_symlink() or not full.resolve().is_relative_to(Path(root).resolve()):
        return None
    return full.read_text("utf-8", "replace") if full.is_file() else None


def _blobs(root: str, commit: str, names: list[str]) -> list[str | None]:
    """Contents of files at a commit by one process; None where there is none."""
    return objects(root, [f"{commit}:{n}" for n in names])


def objects(root: str, names: list[str]) -> list[str | None]:
    """Contents of the objects that are named, by one process; None for what is no file."""
    asked = "".join(f"{n}\n" for n in names).encode()
    done = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=asked, capture_output=True, timeout=600, check=False)
    if done.returncode:
        raise RuntimeError("git failed")
    out, data, at = [], done.stdout, 0
    for _ in names:
        end = data.index(b"\n", at)
        head = data[at:end].rsplit(b" ", 2)
        at = end + 1
        if len(head) == 3 and head[1] == b"blob":
            size = int(head[2])
            out.append(data[at : at + size].decode("utf-8", "replace"))
            at += size + 1
        else:  # "... missing", or something that is no file
            if len(head) == 3 and head[2].isdigit():
                at += int(head[2]) + 1
            out.append(None)
    return out


#: Files that one git process is asked for.
ASKED = 200


def contents(files: DataFrame, root: str, commit: str | None, path: str, into: str) -> DataFrame:
    """files with the content of the column path at a commit, or in the work tree, as the column into."""
    schema = T.StructType([*files.schema.fields, T.StructField(into, T.StringType())])

    def run_(batches):
        for b in batches:
            for a in range(0, len(b), ASKED):
                part = b.iloc[a : a + ASKED].copy()
                names = [n if isinstance(n, str) else None for n in part[path]]
                known = [n for n in names if n is not None and "\n" not in n]
                held = dict(zip(known, _blobs(root, commit, known) if commit and known else [_work_file(root, n) for n in known], strict=True))
                for n in names:  # the batch protocol has no form for such a name
                    if n is not None and "\n" in n:
                        held[n] = run(root, "show", f"{commit}:{n}") if commit else _work_file(root, n)
                part[into] = [held.get(n) for n in names]
                yield part

    return files.mapInPandas(run_, schema)


def snapshot_pairs(spark: SparkSession, root: str, base: str, head: str | None, include: list[str], exclude: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Rows of FILE_CHANGE in scope, and how many ends of changes were unsupported or excluded.

    Each end of a rename is judged by itself: if one is out of scope, the other is an addition or a deletion.
    """
    status = changed_files(spark, root, base, head)
    ends = F.array_distinct(F.filter(F.array("before_path", "after_path"), lambda p: p.isNotNull()))
    known = lambda p: paths.language_of(p).isNotNull()
    inside = lambda p: paths.matches_any(p, include) & ~paths.matches_any(p, exclude or [])
    n = lambda test: F.coalesce(F.sum(F.size(F.filter(ends, test))), F.lit(0))
    seen = Observation()  # the counters come with the job that counts what is left
    status = status.observe(seen, n(lambda p: ~known(p)).alias("unsupported"), n(lambda p: known(p) & ~inside(p)).alias("excluded"))
    keep = lambda c: F.when(paths.in_scope(F.col(c), include, exclude or []), F.col(c))
    held = status.select("status", keep("before_path").alias("before_path"), keep("after_path").alias("after_path")).where("before_path is not null or after_path is not null")
    gone, new = F.col("after_path").isNull(), F.col("before_path").isNull()
    held = held.withColumn("status", F.when(gone, "deleted").when(new, "added").otherwise(F.col("status")))
    held = held.select(F.coalesce("after_path", "before_path").alias("file_id"), "status", "before_path", "after_path")
    count = held.count()
    held = held.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ASKED))))
    held = contents(contents(held, root, base, "before_path", "before_content"), root, head, "after_path", "after_content")
    return held.select(*FILE_CHANGE.names), seen.get
