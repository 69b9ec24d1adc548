"""Reading vectors: what operators 5 and 7 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINITE = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part.

    Left out: null ids, null or empty vectors, zero vectors, null or non-finite components, and vectors of
    another length than most have (the smaller length, if two are as frequent).
    """
    held = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(FINITE)
    lengths = held.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return held.where(F.size("embedding") == (lengths[0].d if lengths else 0))


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Rows of an array column of d doubles each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d) if len(column) else np.zeros((0, d))


def packed(x: np.ndarray) -> pa.Array:
    """Rows of doubles as byte strings: Spark carries those as they are, arrays one element at a time."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, dtype="<f8")], pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Rows of a packed() column of d doubles each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, d) if len(column) else np.zeros((0, d))


def dealt(rows: DataFrame, *keys: str):
    """Groups by the keys over as many partitions as the session asks for: little data can be much work here."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)
