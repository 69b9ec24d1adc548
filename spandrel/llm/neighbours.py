"""Nearest neighbours by stable projections in a kd-tree, with a chi-square stopping test (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.llm.common import durable, forget, prepare, relax, table
from spandrel.llm.vectors import dealt, matrix, packed, unpacked, usable

#: Projected dimensions (even), points of a leaf, and the confidence at which a search stops.
DIMENSIONS, LEAF, CONFIDENCE = 20, 256, 0.9
#: Vectors of a cell, and queries that a task asks of it.
CELL, BLOCK = 16_384, 4096
#: Vectors, of the least hashed ids, from which the planes between cells are drawn. Every vector is indexed.
SAMPLE = 20_000
#: The squared radius of a search grows by this much at a time; the cells of a round are this many times those before.
GROWTH, WIDER = 1.5, 4
#: Queries that are searched together.
TOGETHER = 256


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The distribution function of chi-square with an even number m of degrees of freedom."""
    half = np.minimum(x, 1e4) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_limit(confidence: float, m: int) -> float:
    """The value that chi-square with m degrees of freedom stays below with this chance."""
    low, high = 0.0, 1e4
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if chi_square(np.array([x]), m)[0] < confidence else (low, x)
    return high


class Projection:
    """Gaussian projections of vectors that are brought to one length by one more component.

    Largest inner products are then nearest points, and the squared distance of two projections is the squared
    distance of the vectors times a chi-square variable of m degrees of freedom.
    """

    def __init__(self, d: int, most: float, m: int = DIMENSIONS, seed: int = 5):
        r = np.random.default_rng(seed)
        self.m, self.most = m, most  # most: the largest squared length of all
        self.axes, self.extra = r.normal(size=(d, m)), r.normal(size=(1, m))

    def points(self, x: np.ndarray) -> np.ndarray:
        short = np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.axes + short[:, None] * self.extra

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.axes

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distance of queries from the vectors with which they have these inner products."""
        return np.maximum(np.einsum("ij,ij->i", q, q) + self.most - 2 * score, 1e-300)


def gaps(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of points from boxes."""
    g = np.maximum(np.maximum(low - p, p - high), 0)
    return (g * g).sum(-1)


class ProjectedIndex:
    """The vectors of a cell with a kd-tree over their projections, walked by rising projected distance."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, projection: Projection | None = None, leaf: int = LEAF):
        if projection is None:
            projection = Projection(x.shape[1], float(np.einsum("ij,ij->i", x, x).max(initial=0)))
        self.projection, self.verified = projection, 0
        p = projection.points(x)
        order = np.arange(len(x))
        first, last, child, stack = [0], [len(x)], [-1], [0] if len(x) else []  # nodes; child: the left one's number
        while stack:
            node = stack.pop()
            a, z = first[node], last[node]
            if z - a <= leaf:
                continue
            own = order[a:z]
            axis, middle = int(np.ptp(p[own], axis=0).argmax()), (z - a) // 2
            order[a:z] = own[np.argpartition(p[own, axis], middle)]
            child[node] = len(first)
            first += [a, a + middle]
            last += [a + middle, z]
            child += [-1, -1]
            stack += [len(first) - 2, len(first) - 1]
        self.x, self.ids, self.p = x[order], ids[order], p[order]
        self.first, self.last, self.child = np.array(first), np.array(last), np.array(child)
        if len(x):
            self.low = np.array([self.p[a:z].min(0) for a, z in zip(first, last, strict=True)])
            self.high = np.array([self.p[a:z].max(0) for a, z in zip(first, last, strict=True)])

    def search(self, q: np.ndarray, own: np.ndarray, k: int, confidence: float = CONFIDENCE, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best for each query, best first, ties to smaller ids; -inf where none is.

        floor: an inner product that the k-th best of each query reaches already elsewhere.
        """
        floor = np.full(len(q), -np.inf) if floor is None else floor
        found, score = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
        if len(self.x):
            limit = chi_square_limit(confidence, self.projection.m)
            for a in range(0, len(q), TOGETHER):
                z = a + TOGETHER
                self._walk(q[a:z], own[a:z], floor[a:z], limit, found[a:z], score[a:z])
        return found, score

    def _walk(self, q, own, floor, limit, found, score) -> None:
        """Widen a ball around each query; points in the new shell are verified, in projected order.

        A query is done when its squared radius is `limit` times the squared distance of its k-th best so far:
        P(chi-square <= radius^2 / distance^2) has reached the confidence, so a point that is nearer than the
        k-th best has been left out with at most the remaining chance.
        """
        n, p = len(q), self.projection.queries(q)
        near = np.full((n, len(self.x)), np.inf, "f4")  # squared projected distances, of leaves opened and points not verified
        who, node = np.arange(n), np.zeros(n, np.int64)  # the nodes that wait, each for its query
        gap = gaps(p, self.low[0], self.high[0])
        radius, worst = gap.copy(), floor.copy()
        cap = np.where(np.isfinite(worst), limit * self.projection.distance(q, np.where(np.isfinite(worst), worst, 0)), np.inf)
        while True:
            while len(open_ := np.flatnonzero(gap <= radius[who])):
                w, v = who[open_], node[open_]
                rest = np.ones(len(gap), bool)
                rest[open_] = False
                who, node, gap = who[rest], node[rest], gap[rest]
                leaf = self.child[v] < 0
                for u in np.unique(v[leaf]).tolist():
                    rows, a, z = w[leaf & (v == u)], self.first[u], self.last[u]
                    d2 = (p[rows] ** 2).sum(1)[:, None] + (self.p[a:z] ** 2).sum(1)[None] - 2 * p[rows] @ self.p[a:z].T
                    near[rows, a:z] = d2
                w, v = np.repeat(w[~leaf], 2), (self.child[v[~leaf]][:, None] + np.arange(2)).ravel()
                g = gaps(p[w], self.low[v], self.high[v])
                keep = g <= cap[w]
                who, node, gap = np.concatenate([who, w[keep]]), np.concatenate([node, v[keep]]), np.concatenate([gap, g[keep]])
            ahead = np.full(n, np.inf)
            for i in np.flatnonzero(radius <= cap).tolist():
                shell = np.flatnonzero(near[i] <= radius[i])
                if len(shell):
                    near[i, shell] = np.inf
                    self._verify(q[i], own[i], worst[i], shell, found[i], score[i])
                ahead[i] = near[i].min()
            np.minimum.at(ahead, who, gap)
            worst = np.maximum(score[:, -1], floor)
            cap = np.where(np.isfinite(worst), limit * self.projection.distance(q, np.where(np.isfinite(worst), worst, 0)), np.inf)
            goes = np.isfinite(ahead) & (ahead <= cap)
            if not goes.any():
                return
            radius = np.where(goes, np.minimum(np.maximum(GROWTH * radius, ahead), cap), np.inf)
            cap = np.where(goes, cap, -1.0)
            wait = goes[who]
            who, node, gap = who[wait], node[wait], gap[wait]

    def _verify(self, q, own, worst, places, found, score) -> None:
        """Inner products of one query with points, the best of them into its lists."""
        self.verified += len(places)
        x = self.x[places]
        near = x @ q
        keep = np.flatnonzero(near >= worst - 1e-9 * (1 + abs(worst))) if np.isfinite(worst) else np.arange(len(places))
        s, names = (x[keep] * q).sum(1), self.ids[places[keep]]  # once more row by row, so that equal vectors score alike
        keep = (s >= worst) & (names != own)
        if not keep.any():
            return
        s, names = np.concatenate([s[keep], score]), np.concatenate([names[keep], found])
        order = np.lexsort((names, -s))[: len(score)]
        found[:], score[:] = names[order], s[order]


class Cells:
    """The space of projections cut into 2 ** depth cells by planes at the medians of a sample."""

    def __init__(self, sample: np.ndarray, m: int, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        self.low, self.high = np.full((1 << depth, m), -np.inf), np.full((1 << depth, m), np.inf)
        parts = [sample]
        for node in range((1 << depth) - 1):
            own = parts[node]
            if len(own):
                self.axis[node] = int(np.ptp(own, axis=0).argmax())
                self.at[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] >= self.at[node]
            parts += [own[~right], own[right]]
            parts[node] = None
        for cell in range(1 << depth):
            node = 0
            for level in range(depth):
                right = cell >> (depth - 1 - level) & 1
                side = self.low if right else self.high
                side[cell, self.axis[node]] = self.at[node]
                node = 2 * node + 1 + right

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] >= self.at[node])
        return node - len(self.at)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, m: int = DIMENSIONS, confidence: float = CONFIDENCE, shard: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found for each query.

    1. The projected space is cut into cells of about `shard` vectors, and every vector is written to its cell.
    2. Each query searches its nearest cell, then WIDER times as many, and so on by rising distance, as long as
    the chi-square test does not rule a cell out by the k-th best so far. Only those cells see the query. 3. In a
    cell, a kd-tree is walked by rising projected distance under the same test (ProjectedIndex).

    Both tables have vec_id and embedding; a query's own id is no candidate for it (nor are other rows of the
    same id). Rows of equal id and vector are one candidate. Vectors that usable() leaves out take no part, nor do
    queries of another length than most vectors. A cell that holds far more than its share, as copies do, is dealt
    out by hashed ids; a task has about `shard` vectors and `block` queries. If there are fewer candidates than k,
    all are given; a query without any gives no row, empty tables give an empty result, other columns are not
    looked at.
    """
    spark = prepare(vectors.sparkSession)
    data = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, d, most = data.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(squares)).first()
    d = d or 0
    projection = Projection(d, most or 0.0, m)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    drawn = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect() if depth else []
    cells = Cells(projection.points(np.array([r.embedding for r in drawn]).reshape(len(drawn), d)), m, depth)

    def place(batches):
        for b in batches:
            x = matrix(b.column(1), d)
            yield pa.RecordBatch.from_arrays([pa.array(cells.of(projection.points(x)), pa.int64()), b.column(0), packed(x)], names=["cell", "vec_id", "embedding"])

    placed = durable(data.mapInArrow(place, "cell long, vec_id long, embedding binary"), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2.0 * shard)).cast("int").alias("parts"))

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), packed(matrix(b.column(1), d))], names=["query_id", "embedding"])

    asked = usable(queries).where(F.size("embedding") == d).dropDuplicates(["vec_id", "embedding"])
    asked = durable(asked.mapInArrow(pack, "query_id long, embedding binary"), "asked")
    limit, schema = chi_square_limit(confidence, m), "query_id long, vec_id long, score double"
    best = spark.createDataFrame([], schema)
    low, high = 0, 1
    while low < 1 << depth:
        floors = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= k).drop("k")

        def route(batches, low=low, high=high):
            for b in batches:
                q = unpacked(b.column(1), d)
                floor = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                reach = np.array([gaps(p, cells.low, cells.high) for p in projection.queries(q)]).reshape(len(q), -1)
                order = np.argsort(reach, axis=1, kind="stable")[:, low:high]
                known = np.isfinite(floor)
                cap = np.where(known, limit * projection.distance(q, np.where(known, floor, 0)), np.inf)
                rows, column = np.nonzero(np.take_along_axis(reach, order, 1) <= cap[:, None])
                pick = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(order[rows, column], pa.int64()), *(b.column(i).take(pick) for i in range(3))], names=["cell", "query_id", "embedding", "floor"])

        routed = asked.join(floors, "query_id", "left").select("query_id", "embedding", "floor")
        routed = durable(routed.mapInArrow(route, "cell long, query_id long, embedding binary, floor double"), "routed")
        sizes = parts.join(routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / float(block)).cast("int").alias("blocks")), "cell")
        deal = lambda column, count: F.pmod(F.xxhash64(column), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        left = placed.join(sizes, "cell").select("cell", deal("vec_id", "parts").alias("part"), every("blocks").alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("floor"))
        right = routed.join(sizes, "cell").select("cell", every("parts").alias("part"), deal("query_id", "blocks").alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "embedding", "floor")

        def run(rows: pa.Table) -> pa.Table:
            kind, ids, x = rows.column("kind").to_numpy(), rows.column("id").to_numpy(), unpacked(rows.column("embedding"), d)
            floor = rows.column("floor").to_numpy()[kind == 1].astype(float)
            index, own = ProjectedIndex(x[kind == 0], ids[kind == 0], projection), ids[kind == 1]
            found, score = index.search(x[kind == 1], own, k, confidence, np.where(np.isnan(floor), -np.inf, floor))
            keep = np.isfinite(score)
            out = pa.table([pa.array(np.broadcast_to(own[:, None], found.shape)[keep], pa.int64()), pa.array(found[keep], pa.int64()), pa.array(score[keep], pa.float64())], names=["query_id", "vec_id", "score"])
            relax()
            return out

        got = dealt(left.union(right), "cell", "part", "block").applyInArrow(run, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        before, best = best, best.union(got).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score")
        best = durable(best, "best")
        for old in (routed, before):
            forget(old)
        low, high = high, high * WIDER
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")


def op5_projected_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
