"""Changes of files as a stream: bursts, refreshes of the parse table, and regeneration."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import paths
from spandrel.streaming import changes


def bursts(events: DataFrame, time: str, pause: str, keys: list[str] | None = None) -> DataFrame:
    """One row for each burst of events of a key: first, last, events. A pause longer than `pause` ends a burst.

    Works on tables and streams; a stream needs a watermark on the time column and gives a burst when it has
    passed. Two events exactly `pause` apart are of one burst.
    """
    keys = keys or []
    grouped = events.groupBy(F.session_window(time, pause), *keys)
    return grouped.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("events")).drop("session_window")


def to_refresh(now: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Files of which the parse table has no row, or one of another version (path and what tells versions)."""
    return now.join(held.select(*key).distinct(), key, "left_anti")


def refresh(now: DataFrame, held: DataFrame, key: list[str], parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The parse table after a refresh: rows that are still right, and parsed ones for the rest."""
    keep = held.join(now.select(*key), key, "left_semi")
    return keep.unionByName(parse(to_refresh(now, held, key)))


def watched(events: DataFrame) -> DataFrame:
    """Events (path, ...) of files that documentation is made from."""
    return events.where(paths.is_watched(F.col("path")))


#: The attempts of the command, and the seconds before its second.
ATTEMPTS, WAIT = 3, 0.2


class _Pending:
    """Changes that no regeneration has succeeded with yet, kept beside the checkpoint until one does."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, number: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{number}")

    def with_new(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """What is pending and df, the latest row of each path, and the folders that it is from."""
        held = [str(s.getPath()) for s in self.files.listStatus(self.path)] if self.files.exists(self.path) else []
        if not held:
            return df, []
        every = df.withColumn("late", F.lit(1)).unionByName(self.spark.read.schema(df.schema).parquet(*held).withColumn("late", F.lit(0)))
        rest = F.struct(*(c for c in df.columns if c != "path"))
        return every.groupBy("path").agg(F.max_by(rest, F.struct("late", "modified")).alias("r")).select("path", "r.*"), held

    def done(self, folders: list[str]) -> None:
        for f in folders:
            self.files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f), True)


def watch(spark: SparkSession, directory: str, regenerate: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, existing: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, pause: float = changes.PAUSE, attempts: int = 1):
    """Follow a folder at any depth: each burst of edits, additions and deletions of watched files goes to regenerate().

    It gets rows of the file_changes source and the number of the batch. With more attempts than one a failure is tried
    again, ever later; after the last the changes wait beside the checkpoint for the next batch, also over a restart, and
    the watch goes on.
    """
    rows = watched(changes.read_changes(spark, directory, include or ["**/*"], exclude, 0 if once else pause, existing))
    pending = _Pending(spark, f"{checkpoint.rstrip('/')}/pending")

    def batch(df: DataFrame, number: int) -> None:
        df, held = pending.with_new(df)
        df = df.persist()
        try:
            if df.isEmpty():
                return
            for k in range(attempts):
                try:
                    regenerate(df, number)
                except Exception as error:
                    logging.getLogger("spandrel").error("regeneration of batch %d failed: %s", number, type(error).__name__)
                    time.sleep(WAIT * 2**k if k + 1 < attempts else 0)
                else:
                    break
            else:
                pending.keep(number, df)
                held = [h for h in held if not h.endswith(f"/{number}")]
            pending.done(held)
        finally:
            df.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 milliseconds")).start()
