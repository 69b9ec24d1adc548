"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, a folder of our own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_spandrel_folder", None):
        sc._spandrel_folder = "file://" + tempfile.mkdtemp(prefix="spandrel-")
    return sc._spandrel_folder


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, written once and read back: what reads them many times does not make them again, and a lost
    executor costs no more than its own part."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of written() tables that nothing will read again."""
    for df in tables:
        names = df.inputFiles()
        if names:
            jvm = df.sparkSession.sparkContext._jvm
            parent = jvm.org.apache.hadoop.fs.Path(names[0]).getParent()
            parent.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
