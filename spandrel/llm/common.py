"""What the corpus operators share: reading, shipping code, bounded Arrow batches, durable tables."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import time
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that a Python worker holds at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018 - another C library has no such function
except (OSError, AttributeError):
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once a session, and bound the Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not getattr(sc, "_spandrel_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        path = os.path.join(tempfile.mkdtemp(), "spandrel.zip")
        with open(path, "wb") as f:
            f.write(held.getvalue())
        sc.addPyFile(path)  # Spark's file server hands it to every executor
        sc._spandrel_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode one of our own will do where it is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark.sparkContext, "_spandrel_shared", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="spandrel-")
            spark.sparkContext._spandrel_shared = at
    return at.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: they stay until both sides have collected their garbage.

    The driver hears of what Python has dropped only after a while, hence twice.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def relax() -> None:
    """Give freed memory back to the system: a worker lives on, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a durable() table that nothing will read again."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        parent = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        parent.getFileSystem(conf).delete(parent, True)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the decimal text of an id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_HELD: list = [None]


def hold(memo) -> None:
    """Make memo the one that keeps what it has in this worker: workers live on from operator to operator."""
    if _HELD[0] is not memo:
        if _HELD[0] is not None:
            _HELD[0].clear()
        _HELD[0] = memo


class Bounded(dict):
    """A memo that empties itself when it is full; make() computes what is missing."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            hold(self)
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id reached.

    Large-star and small-star rounds: each round is two aggregations whose keys are vertices and whose
    values are minima, so a vertex of any degree is combined before the shuffle. Every round is written to
    the shared folder. The number of rounds grows with the logarithm of the longest path; most_rounds is far beyond
    what any table needs, and an unfinished labelling is an error.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    known = mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        then = durable(small, "cc")
        forget(now)
        now, before, known = then, known, mark(then)
        if known == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
