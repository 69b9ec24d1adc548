"""Which settings hold for which file: those of the nearest folder above it that has any, and none where these are unsafe.

A folder has settings by the first of these that is there: the key spandrel of package.json, spandrel.json,
.config/spandrel.json. Settings that would have to be executed, that cannot be read, or that hold a credential are
unsafe; an unsafe folder does not give way to the one above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import paths

NAME = "spandrel"
#: Names below a folder, the first that is there counts.
DECLARED = ("package.json", f"{NAME}.json", f".config/{NAME}.json")
EXECUTABLE = tuple(f"{folder}{NAME}.config.{suffix}" for folder in ("", ".config/") for suffix in ("js", "cjs", "mjs", "ts", "py"))
#: Keys that hold credentials, at any depth.
CREDENTIALS = r'"(?:apiKey|api_key|token|secret|password)"\s*:'
MOST_DEPTH = 256


def _folder(path: Column, name: Column) -> Column:
    """What of path stands before name: "" or a folder."""
    return F.regexp_replace(F.substr(path, F.lit(1), F.char_length(path) - F.char_length(name)), "/$", "")


def folder_settings(files: DataFrame) -> DataFrame:
    """(folder, settings, source, unsafe) of every folder that has settings, from files (path, content)."""
    names = F.array(*map(F.lit, (*DECLARED, *EXECUTABLE)))
    own = files.withColumn("name", F.filter(names, lambda n: (F.col("path") == n) | F.col("path").endswith(F.concat(F.lit("/"), n))))
    own = own.where(F.size("name") > 0).withColumn("name", F.try_element_at("name", F.lit(-1)))  # of .config/x and x the longer
    own = own.withColumn("folder", _folder(F.col("path"), F.col("name")))
    text = F.col("content")
    parsed = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    inner = F.to_json(F.try_variant_get(parsed, f"$.{NAME}", "variant"))
    package = F.col("name") == DECLARED[0]
    settings = F.when(package, inner).otherwise(F.when(is_object, F.to_json(parsed)))
    executable = F.col("name").isin(*EXECUTABLE)
    broken = ~executable & (text.isNull() | ~is_object | (package & inner.isNotNull() & ~F.coalesce(inner.startswith("{"), F.lit(False))))
    unsafe = executable | broken | F.coalesce(settings.rlike(CREDENTIALS), F.lit(False))
    rank = F.array_position(F.array(*map(F.lit, (*DECLARED[:2], *EXECUTABLE[:5], DECLARED[2], *EXECUTABLE[5:]))), F.col("name"))
    rows = own.select("folder", F.struct(rank.alias("rank"), F.when(~unsafe, settings).alias("settings"), F.col("path").alias("source"), unsafe.alias("unsafe")).alias("s"), (package & inner.isNull() & ~broken).alias("nothing"))
    return rows.where(~F.col("nothing")).groupBy("folder").agg(F.min("s").alias("s")).select("folder", "s.settings", "s.source", "s.unsafe")


def ancestors(path: Column) -> Column:
    """array<struct<depth, folder>> of the folders that hold a path, from the root, "", on."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("folder")))


def nearest(files: DataFrame, settings: DataFrame) -> DataFrame:
    """files (path, ...) with folder, settings, source and unsafe of the nearest folder above each; null if none has any.

    Each file meets its own ancestors, so the join is on folders and its work files times depth. A path of more than
    MOST_DEPTH parts, or one that leaves the root, is an error.
    """
    bad = (F.size(F.split("path", "/")) > MOST_DEPTH) | ~paths.is_repository_relative(F.col("path"))
    checked = F.when(bad, F.raise_error(F.lit("a path is too deep or leaves the root")).cast("string")).otherwise(F.col("path"))
    rows = files.select(checked.alias("path")).distinct().select("path", F.explode(ancestors(F.col("path"))).alias("a")).select("path", "a.*")
    best = rows.join(settings, "folder").groupBy("path").agg(F.max_by(F.struct("folder", "settings", "source", "unsafe"), "depth").alias("s"))
    return files.join(best.select("path", "s.*"), "path", "left")


def required(found: DataFrame) -> DataFrame:
    """The same rows; the job fails where a file's settings are unsafe."""
    return found.withColumn("settings", F.when(F.coalesce("unsafe", F.lit(False)), F.raise_error(F.lit("settings are unsafe")).cast("string")).otherwise(F.col("settings")))
