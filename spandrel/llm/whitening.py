"""Operator 13: whitening of integer vectors from an exact covariance, by digit-slice products.

Every entry c becomes the integer x = floor(1024 c) + 100000. Two passes over the vectors gather exact sums: the first
n, S and the range of each dimension, the second the products of z = x - floor(S / n). A task cuts its z into limbs of
LIMB bits, so that a float64 matrix product over BLOCK rows stays below 2^53 and is exact; Spark adds the products of
equal weight cell by cell, and the driver puts the d x d sums together as whole numbers of any size. Only then does
anything become a float: the covariance, (n G - r r') / n^2 with r = S - n floor(S / n), rounded once, and its
eigenvectors. Nothing that grows with the rows comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import prepare, table

SCALE, SHIFT = 1024, 100_000
#: Limbs are signed digits in [-2^(LIMB-1), 2^(LIMB-1)); BLOCK products of two stay below 2^52.
LIMB, BLOCK = 20, 8192
COMPONENTS = 8
#: An eigenvalue below this share of the largest is no variance, but what rounding leaves of none.
NOTHING = 1e-13

_GOOD = "embedding is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<long>) of the vectors that take part, zero vectors and null ids among them.

    Left out: null or empty vectors, null or non-finite entries, and vectors of another length than most have (the
    smaller length, if two are as frequent). floor() ends at the limits of a long, and so does x.
    """
    held = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(_GOOD)
    lengths = held.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    top = (1 << 63) - 1 - SHIFT
    entry = lambda c: F.least(F.floor(c * SCALE), F.lit(top)) + SHIFT
    return held.where(F.size("embedding") == (lengths[0].d if lengths else 0)).select("vec_id", F.transform("embedding", entry).alias("x"))


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = batch.column("x")
    return np.asarray(x.flatten(), dtype=np.int64).reshape(-1, d) if len(x) else np.zeros((0, d), np.int64)


def limbs(z: np.ndarray, most: int) -> list[np.ndarray]:
    """Signed digits of z, the lowest first, enough for entries of absolute value up to most; sum(l << LIMB * k) is z."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        low = ((z + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        if most < half:
            return out
        z, most = (z - low) >> LIMB, (most >> LIMB) + 1


def products(z: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """z'z for at most BLOCK rows, as int64 matrices by the number of limbs they have to be shifted by."""
    held = limbs(z, most)
    out: dict[int, np.ndarray] = {}
    for i, a in enumerate(held):
        for j in range(i, len(held)):
            p = (a.T @ held[j]).astype(np.int64)  # below 2^52, so exact
            out[i + j] = out.get(i + j, 0) + (p if i == j else p + p.T)
    return out


def recombine(parts: dict[int, np.ndarray]) -> np.ndarray:
    """The sum of the matrices, shifted, as Python integers."""
    out = None
    for k, p in parts.items():
        p = p.astype(object) * (1 << (LIMB * k))
        out = p if out is None else out + p
    return out


_CELL = T.StructType([T.StructField("shift", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("value", T.LongType())])


def _summed(cells: DataFrame, *keys: str) -> list:
    """Sums of longs, exact: a decimal of 38 digits holds more rows of them than there can be."""
    return cells.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()


def moments(x: DataFrame, d: int) -> tuple[int, list[int], int, int]:
    """n, the exact sums of the dimensions, and the least and largest entry."""
    low, shift = 1 << 32, 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, halves, least, most = 0, np.zeros((2, d), np.int64), None, None
        for b in batches:
            v = _rows(b, d)
            if len(v):
                n += len(v)
                halves += np.stack([(v & (low - 1)).sum(0), (v >> shift).sum(0)])  # halves of 32 bits: 2^31 rows fit
                least, most = (int(v.min()), int(v.max())) if n == len(v) else (min(least, int(v.min())), max(most, int(v.max())))
        if n:
            cells = halves.ravel()
            yield pa.record_batch({"cell": pa.array([*range(2 * d), -1, -2, -3], pa.int32()), "value": pa.array([*cells.tolist(), n, least, most], pa.int64())})

    got = x.select("x").mapInArrow(run, "cell int, value long")
    rows = got.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.min("value").alias("least"), F.max("value").alias("most")).collect()
    of = {r.cell: r for r in rows}
    if not of:
        return 0, [], 0, 0
    s = [int(of[k].s) + (int(of[d + k].s) << shift) for k in range(d)]
    return int(of[-1].s), s, of[-2].least, of[-3].most


def scatter(x: DataFrame, d: int, middle: list[int], most: int) -> np.ndarray:
    """Exact sums of z z' over all rows, z = x - middle, as Python integers."""
    wide = most >= 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.array(middle, dtype=object if wide else np.int64)
        total: dict[int, np.ndarray] = {}
        for b in batches:
            v = _rows(b, d)
            for at in range(0, len(v), BLOCK):
                part = v[at : at + BLOCK]
                for k, p in products(part.astype(object) - m if wide else part - m, most).items():
                    total[k] = total.get(k, 0) + p
        # sums of int64: 2^52 a block leaves room for 2^11 blocks, hence a flush of each task's rows in pieces
        for k, p in total.items():
            yield pa.record_batch({"shift": pa.array(np.full(d * d, k), pa.int32()), "cell": pa.array(np.arange(d * d), pa.int32()), "value": pa.array(p.ravel(), pa.int64())})

    def flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 64 * BLOCK:  # 64 blocks and the ends of the batches: below 2^60
                yield from run(held)
                held, rows = [], 0
        yield from run(held)

    out = {}
    for r in _summed(x.select("x").mapInArrow(flushed, _CELL), "shift", "cell"):
        out.setdefault(r["shift"], np.zeros(d * d, dtype=object))[r.cell] = int(r.value)
    return recombine(out).reshape(d, d)


class Whitening:
    """What fit() finds: n, the middle m and rest r of each mean (S = n m + r), components, eigenvalues, trace."""

    def __init__(self, n: int, middle: list[int], rest: list[int], components: np.ndarray, values: np.ndarray, trace: float, most: int):
        self.n, self.middle, self.rest, self.components, self.values, self.trace, self.most = n, middle, rest, components, values, trace, most

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened rows of z = x - middle."""
        centred = z.astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ self.components / np.sqrt(self.values)

    def deviations(self, z: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2 = (n z - r)^2 of each row."""
        r, d = np.array(self.rest, dtype=object), z.shape[1]
        small = self.most * self.most * d < 1 << 62 and self.n * self.most * d < 1 << 62
        if small:  # the three sums fit longs; only their combination needs more
            a, b = (z * z).sum(1), z @ r.astype(np.int64)
        else:
            z = z.astype(object)
            a, b = (z * z).sum(1), z @ r
        c, n = sum(v * v for v in self.rest), self.n
        return [n * n * p - 2 * n * q + c for p, q in zip(a.tolist(), b.tolist(), strict=True)]


def fit(x: DataFrame, d: int, most_components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of x; None where there is no row. Components without variance are left out."""
    n, s, least, most = moments(x, d)
    if not n:
        return None
    middle = [v // n for v in s]
    rest = [v - n * m for v, m in zip(s, middle, strict=True)]
    reach = max(most - min(middle), max(middle) - least)
    g = scatter(x, d, middle, reach)
    v = np.array([[(n * g[i, j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)], dtype=np.float64)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    trace = sum(n * g[i, i] - rest[i] * rest[i] for i in range(d)) / (n * n)
    keep = [k for k in order[:most_components] if values[k] > NOTHING * values[order[0]]] if values[order[0]] > 0 else []
    found = vectors[:, keep]
    if keep:
        found = found * np.sign(found[np.abs(found).argmax(0), np.arange(len(keep))])
    return Whitening(n, middle, rest, found, values[keep], trace, reach)


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    d, k = len(model.middle), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = model.project(_shifted(_rows(b, d), model))
            if len(w):
                own, step = w.mean(0), None
                c = w - own
                step, total = own - mean, n + len(w)
                m2 += c.T @ c + np.outer(step, step) * (n * len(w) / total)
                mean, n = mean + step * (len(w) / total), total
        if n:
            cells = [*(n * mean), *(m2 + n * np.outer(mean, mean)).ravel()]
            yield pa.record_batch({"cell": pa.array(range(len(cells)), pa.int32()), "value": pa.array(cells, pa.float64())})

    got = x.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    cells = np.array([r.value for r in sorted(got, key=lambda r: r.cell)]) / model.n
    mean = cells[:k]  # about 1e-16 here, so that taking it off after the sum loses nothing
    return float(np.abs(cells[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _shifted(v: np.ndarray, model: Whitening) -> np.ndarray:
    wide = model.most >= 1 << 62
    return v.astype(object) - np.array(model.middle, dtype=object) if wide else v - np.array(model.middle, dtype=np.int64)


def whiten(vectors: DataFrame, most_components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation_text, deviation, whitened, explained, identity_error).

    Every vector that takes part (usable()) has a row for each of the first components, by falling eigenvalue.
    Repeated rows count each by itself, a null vec_id stays null, other columns are not looked at, an empty table and
    one whose vectors are all equal give no rows. The entry of a component that is largest by its absolute value is
    positive. deviation is null where the exact number, deviation_text, is no long.
    """
    spark = prepare(vectors.sparkSession)
    x = usable(vectors)
    first = x.select(F.size("x").alias("d")).first()
    model = fit(x, first.d, most_components) if first else None
    schema = "vec_id long, component int, n long, deviation_text string, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error, d, k = identity_error(x, model), first.d, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _shifted(_rows(b, d), model)
            exact = model.deviations(z)
            fits = [v if v < 1 << 63 else None for v in exact]
            yield pa.record_batch(
                {
                    "vec_id": b.column("vec_id").take(pa.array(np.repeat(np.arange(len(z)), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()),
                    "deviation_text": pa.array([str(v) for v in exact for _ in range(k)], pa.string()),
                    "deviation": pa.array([v for v in fits for _ in range(k)], pa.int64()),
                    "whitened": pa.array(model.project(z).ravel(), pa.float64()),
                }
            )

    rows = x.mapInArrow(run, "vec_id long, component int, deviation_text string, deviation long, whitened double")
    share = F.element_at(F.array(*(F.lit(float(v / model.trace)) for v in model.values)), F.col("component"))
    return rows.select("vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation_text", "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text")
