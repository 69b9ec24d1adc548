"""Whether a document changed together with the sources it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import paths
from spandrel.operators import parse


def verdict(exists: Column, n_sources: Column, target_changed: Column) -> Column:
    return F.when(~exists, "missing").when((n_sources > 0) & ~target_changed, "stale").when(n_sources == 0, "clean").otherwise("co-changed")


def message(status: Column, target: Column, n_sources: Column) -> Column:
    return (
        F.when(status == "missing", F.concat(F.lit("Documentation target is missing: "), target))
        .when(status == "stale", F.concat(n_sources.cast("string"), F.lit(" source file(s) changed without "), target))
        .when(status == "clean", F.lit("No source changes that documentation depends on"))
        .otherwise(F.concat(target, F.lit(" changed with its source files; its content was not checked")))
    )


def assess(changed: DataFrame, target: str, exists: bool) -> DataFrame:
    """One row (status, target, target_changed, source_files, message) for changed files (path)."""
    held = changed.select(paths.normal(F.col("path")).alias("path")).distinct()
    name = target[2:] if target.startswith("./") else target
    sources = F.array_sort(F.collect_set(F.when(paths.is_documentation_source(F.col("path")), F.col("path"))))
    out = held.agg(sources.alias("source_files"), F.coalesce(F.bool_or(F.col("path") == name), F.lit(False)).alias("target_changed"))
    status = verdict(F.lit(exists), F.size("source_files"), F.col("target_changed"))
    return out.select(status.alias("status"), F.lit(name).alias("target"), "target_changed", "source_files", message(status, F.lit(name), F.size("source_files")).alias("message"))


def parsed_sources(changed: DataFrame, files: DataFrame) -> DataFrame:
    """path of the changed sources that documentation is made from, each proved by parsing it.

    files: path and content. The job fails where a changed source is not there or cannot be parsed.
    """
    held = changed.select(paths.normal(F.col("path")).alias("path")).where(paths.is_documentation_source(F.col("path"))).distinct()
    there = held.join(files.select("path", "content"), "path", "left")
    lost = F.raise_error(F.concat(F.lit("a changed source file is not there: "), F.col("path"))).cast("string")
    parsed = parse.require_parsed(parse.parse_modules(there.withColumn("content", F.coalesce("content", lost))))
    return parsed.where("error is null").select("path").orderBy("path")


EXIT_CODES = {"clean": 0, "co-changed": 0, "stale": 1, "missing": 1, "unknown": 2}
