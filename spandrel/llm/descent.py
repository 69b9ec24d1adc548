"""Near-equal vectors by NN-descent (operator 7)."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.llm.common import components, durable, forget, prepare, table
from spandrel.llm.vectors import FINITE, dealt, matrix, packed, unpacked, usable

#: Neighbours of a list at first, and at most: a list is doubled whenever it is full of links.
LIST, MOST_LIST = 8, 64
#: Vectors of a part of a random partition, and partitions that a round adds to the lists.
PART, TABLES = 512, 4
#: The chance that all partitions together part a pair that is just at the threshold; it fixes their number.
MISS = 1e-3
#: Directions of one level of a partition, at most.
DIRECTIONS = 128
#: Vectors of the audit, the recall that ends the rounds, and the least that is ever accepted.
AUDIT, RECALL, LEAST_RECALL = 512, 0.98, 0.9
#: Rounds that may follow after the partitions.
ROUNDS = 12
#: Vectors of a block when a crowded component is counted.
BLOCK = 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(out: list[tuple]) -> pa.Table:
    a, b, s = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "s"])


def _top(candidates: DataFrame, threshold: float) -> DataFrame:
    """The best candidates (a, b, s, size) of each a: as many as its list holds, twice that if it is full of links."""
    once = candidates.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("size").alias("size"))
    held = Window.partitionBy("a")
    ranked = once.withColumn("size", F.max("size").over(held)).withColumn("at", F.row_number().over(held.orderBy(F.desc("s"), "b")))
    links = F.sum((F.col("s") >= threshold).cast("int")).over(held)
    grown = F.when(links >= F.col("size"), F.least(2 * F.col("size"), F.lit(MOST_LIST))).otherwise(F.col("size"))
    return ranked.withColumn("size", grown).where("at <= size").select("a", "b", "s", "size")


class Partition:
    """A random partition of the sphere: at each level a vector goes to the nearest of some random directions.

    There are about `cells` cells; `fine` further directions part the vectors of a cell that holds too many.
    """

    def __init__(self, d: int, cells: int, seed: int):
        r = np.random.default_rng([seed, 77])
        levels = max(1, int(np.ceil(np.log(max(cells, 2)) / np.log(DIRECTIONS)))) if cells > 1 else 0
        each = max(1, int(np.ceil(cells ** (1 / levels) / 2))) if levels else 0
        self.levels = [r.normal(size=(d, each)) for _ in range(levels)]
        self.fine = r.normal(size=(d, DIRECTIONS // 2))

    @staticmethod
    def nearest(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
        s = x @ directions
        k = np.abs(s).argmax(1)
        return 2 * k + (s[np.arange(len(s)), k] > 0)

    def cell(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for directions in self.levels:
            out = out * (2 * directions.shape[1]) + self.nearest(x, directions)
        return out


def partitions(n: int, d: int, threshold: float, miss: float = MISS) -> int:
    """So many random partitions that a pair at the threshold is in one cell of at least one, but for a chance of miss.

    The chance of a single partition is measured on drawn pairs.
    """
    cells = -(-n // PART)
    if cells <= 1:
        return 1
    r = np.random.default_rng(13)
    same = []
    for seed in range(8):
        x = _unit(r.normal(size=(1000, d)))
        off = r.normal(size=(1000, d))
        off -= (off * x).sum(1, keepdims=True) * x
        y = threshold * x + np.sqrt(1 - threshold**2) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
        cut = Partition(d, cells, 1000 + seed)
        same.append(np.mean(cut.cell(x) == cut.cell(y)))
    return max(1, int(np.ceil(np.log(miss) / np.log1p(-min(max(float(np.mean(same)), 1e-4), 0.999999)))))


def _parts(units: DataFrame, d: int, cells: int, seeds: range, keep: int, threshold: float, least: float) -> DataFrame:
    """Candidates (a, b, s) inside the cells of some random partitions.

    A vector gives its LIST nearest, and up to `keep` that link; none below `least`. A cell of more than twice PART
    is parted by further directions, and what is still too large, as copies are, is dealt out at random: other
    partitions deal it otherwise.
    """
    cuts = [Partition(d, cells, s) for s in seeds]

    def code(batches):
        for b in batches:
            x = unpacked(b.column(1), d)
            for t, cut in enumerate(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(cut.cell(x)), pa.array(cut.nearest(x, cut.fine)), b.column(0), b.column(1)], names=["t", "cell", "fine", "id", "unit"])

    coded = units.mapInArrow(code, "t int, cell long, fine long, id long, unit binary")
    if cells > 1:
        seen = durable(coded.groupBy("t", "cell", "fine").agg(F.count(F.lit(1)).alias("k")), "cells")
        big = seen.groupBy("t", "cell").agg(F.sum("k").alias("k")).where(F.col("k") > 2 * PART).select("t", "cell", F.ceil(F.col("k") / PART).alias("subs"))
        sub = F.when(F.col("subs").isNull(), F.lit(0)).otherwise(F.pmod("fine", "subs"))
        heavy = seen.join(big, ["t", "cell"], "left").withColumn("sub", sub).groupBy("t", "cell", "sub").agg(F.sum("k").alias("k")).where(F.col("k") > 2 * PART)
        heavy = heavy.select("t", "cell", "sub", F.ceil(F.col("k") / (2 * PART)).alias("deals"))
        coded = coded.join(big, ["t", "cell"], "left").withColumn("sub", sub).join(heavy, ["t", "cell", "sub"], "left")
        coded = coded.withColumn("deal", F.pmod(F.xxhash64("id", "t", F.lit(seeds.start)), F.coalesce("deals", F.lit(1))))
    else:
        deals = F.lit(1)
        coded = coded.withColumn("sub", F.lit(0)).withColumn("deal", deals)

    def run(rows: pa.Table) -> pa.Table:
        ids, x = rows.column("id").to_numpy(), unpacked(rows.column("unit"), d)
        out = []
        for i in range(0, len(x), 256):
            s = x[i : i + 256] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            k = min(keep, len(x) - 1)
            if k > 0:
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(s, at, 1)
                order = np.argsort(-got, axis=1)
                at, got = np.take_along_axis(at, order, 1), np.take_along_axis(got, order, 1)
                good = (got >= least) & ((np.arange(k)[None] < LIST) | (got >= threshold))
                out.append((np.broadcast_to(ids[i : i + 256, None], at.shape)[good], ids[at][good], got[good]))
        return _rows(out)

    return dealt(coded.select("t", "cell", "sub", "deal", "id", "unit"), "t", "cell", "sub", "deal").applyInArrow(run, "a long, b long, s double")


def _descend(lists: DataFrame, units: DataFrame, d: int, least: float) -> DataFrame:
    """One round: neighbours of the same vector, in either direction, are compared with each other.

    Twice LIST neighbours of each direction take part. A vector is offered what is better than the end of its list,
    or anything as long as the list is not full.
    """
    ends = lists.groupBy("a").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("k"), F.max("size").alias("size"))
    worst = ends.select(F.col("a").alias("id"), F.when(F.col("k") >= F.col("size"), F.col("worst")).otherwise(F.lit(least)).alias("worst"))
    both = lists.select(F.col("a").alias("v"), F.col("b").alias("u"), "s", F.lit(0).alias("way")).union(lists.select(F.col("b"), F.col("a"), "s", F.lit(1)))
    near = Window.partitionBy("v", "way").orderBy(F.desc("s"), "u")
    members = both.withColumn("at", F.row_number().over(near)).where(F.col("at") <= 2 * LIST).select("v", "u").distinct()
    known = units.join(worst, "id", "left").select(F.col("id").alias("u"), F.coalesce("worst", F.lit(least)).alias("worst"), "unit")
    around = members.join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "worst", "unit")).alias("m"))

    def run(batches):
        for b in batches:
            flat = b.column(0).flatten()
            ids_, worst_, unit_ = flat.field("u").to_numpy(), flat.field("worst").to_numpy(), unpacked(flat.field("unit"), d)
            out, start = [], 0
            for end in np.cumsum(np.asarray(b.column(0).value_lengths())).tolist():
                ids, x, w = ids_[start:end], unit_[start:end], worst_[start:end]
                start = end
                if len(ids) < 2:
                    continue
                s = x @ x.T
                np.fill_diagonal(s, -2)
                s[s <= w[:, None]] = -3  # no better than what the list has
                k = min(LIST, len(ids) - 1)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(s, at, 1)
                keep = got > -2.5
                if keep.any():
                    out.append((np.broadcast_to(ids[:, None], at.shape)[keep], ids[at][keep], got[keep]))
            if out:
                yield from _rows(out).to_batches()

    return around.select("m").mapInArrow(run, "a long, b long, s double")


def _audit(lists: DataFrame, units: DataFrame, d: int, threshold: float) -> tuple[int, int]:
    """(found, true) links of AUDIT vectors: half of them drawn from all, half from those that link.

    The vectors are compared with all rows. Those whose list cannot grow any more take no part: their links are
    counted in full anyway.
    """
    ends = lists.where(F.col("s") >= threshold).groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    order = lambda c: (F.xxhash64(c, F.lit(29)), c)
    linked = ends.where(F.col("k") < MOST_LIST).orderBy(*order("a")).limit(AUDIT // 2).select(F.col("a").alias("id"))
    plain = units.select("id").join(ends.where(F.col("k") >= MOST_LIST).withColumnRenamed("a", "id"), "id", "left_anti").orderBy(*order("id")).limit(AUDIT // 2)
    chosen = sorted({r.id for part in (linked, plain) for r in part.collect()})
    drawn = {r.id: r.unit for r in units.where(F.col("id").isin(chosen)).select("id", "unit").collect()} if chosen else {}
    if not drawn:
        return 0, 0
    ids = np.array(sorted(drawn))
    x = np.array([np.frombuffer(drawn[i], "<f8") for i in ids.tolist()])

    def scan(batches):
        for b in batches:
            own = b.column(0).to_numpy()
            rows, columns = np.nonzero(unpacked(b.column(1), d) @ x.T >= threshold)
            keep = own[rows] != ids[columns]
            yield pa.RecordBatch.from_arrays([pa.array(ids[columns][keep], pa.int64()), pa.array(own[rows][keep], pa.int64())], names=["a", "b"])

    # a link counts as found if either end has it; a vector of the audit has fewer than MOST_LIST of those
    true = units.select("id", "unit").mapInArrow(scan, "a long, b long")
    links = lists.where(F.col("s") >= threshold).select("a", "b")
    links = links.union(links.select(F.col("b"), F.col("a"))).distinct().withColumn("hit", F.lit(1))
    hit, total = true.join(links, ["a", "b"], "left").agg(F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))).first()
    return int(hit or 0), int(total)


def _inside(named: DataFrame, units: DataFrame, d: int, threshold: float) -> DataFrame:
    """For each vector of a component, how many rows of others in it link: all pairs, block by block.

    A component is cut into blocks of about BLOCK vectors by hashed id; each pair of its blocks is a group of
    its own, and counts leave it, never pairs.
    """
    sized = named.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    cut = named.join(sized, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.join(units, "id").select("component", "id", "n", "unit", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "n", "unit")

    def run(rows: pa.Table) -> pa.Table:
        ids, n, x = rows.column("id").to_numpy(), rows.column("n").to_numpy(), unpacked(rows.column("unit"), d)
        block = rows.column("block").to_numpy()
        one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
        counts = np.zeros(len(ids), np.int64)
        for i in range(0, len(a), 256):
            rows_ = a[i : i + 256]
            link = x[rows_] @ x[b].T >= threshold
            link &= ids[rows_][:, None] != ids[b][None]
            counts[rows_] += link @ n[b]
            if one != two:
                counts[b] += n[rows_] @ link
        return pa.table([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["id", "links"])

    return dealt(cut, "component", "one", "two").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def descend(units: DataFrame, n: int, d: int, threshold: float = 0.9, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """Lists (a, b, s, size) of the neighbours of units (id, unit), and the recall of their links.

    Each round adds TABLES random partitions and joins neighbours of neighbours. After all partitions() of them,
    rounds end when they bring no more links and the audit holds. A neighbour that is farther than two links
    apart leads to no link, so lists leave it out. If the audit ends below LEAST_RECALL this raises an error.
    """
    least = 2 * threshold * threshold - 1 if threshold > 0 else -2.0  # the cosine of twice the angle
    cells, tables = max(1, -(-n // PART)), partitions(n, d, threshold)
    spark = units.sparkSession
    lists = spark.createDataFrame([], "a long, b long, s double, size int")
    made, links, keep, recall = 0, -1, LIST, 1.0
    for turn in range(-(-tables // TABLES) + rounds + 1):
        more = None
        if made < tables:
            more = _parts(units, d, cells, range(made, min(made + TABLES, tables)), keep, threshold, least)
            made = min(made + TABLES, tables)
        if turn:
            joined = _descend(lists, units, d, least)
            more = joined if more is None else more.union(joined)
        new = durable(_top(lists.union(more.withColumn("size", F.lit(LIST))), threshold), "lists")
        forget(lists)
        lists, keep = new, min(2 * keep, MOST_LIST)
        before, links = links, lists.where(F.col("s") >= threshold).count()
        if made < tables or (links != before and turn < tables // TABLES + rounds):
            continue
        found, true = _audit(lists, units, d, threshold)
        recall = found / true if true else 1.0
        logging.getLogger(__name__).info("audit: %d of %d links of the vectors drawn, %d partitions, %d rounds", found, true, made, turn + 1)
        if recall >= RECALL:
            break
        if cells > 1:
            tables += 2 * TABLES  # fresh partitions
    if recall < LEAST_RECALL:
        raise RuntimeError(f"only {recall:.3f} of the links were found")
    return lists, recall


def near_copies(vectors: DataFrame, threshold: float = 0.9, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    1. Equal vectors are one class. 2. descend() refines lists of neighbours until an audit holds. 3. Entries of
    at least the threshold are the links, in both directions; components are what they reach. 4. A list that holds
    MOST_LIST links may lack more: in a component with such a list all pairs are compared in blocks and counted,
    so every link inside it counts; pairs never leave a task.

    Links below the threshold are never taken. The rounds can miss links, about MISS of isolated pairs at the
    threshold. Vectors that usable() leaves out link with nothing. Rows that repeat a vec_id are one vector each,
    and each row has the links and the component of its own vector; a null vec_id stays null and links with
    nothing. Empty tables give an empty result; other columns are not looked at.
    """
    prepare(vectors.sparkSession)
    clean = durable(usable(vectors), "vectors")
    first = clean.first()
    d = len(first.embedding) if first else 0
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if not d:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    # a class has a key of its own, written once: several can have the same least vec_id if rows repeat it
    classes = clean.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = durable(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def unit(batches):
        for b in batches:
            x = _unit(matrix(b.column(2), d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(x)], names=["id", "n", "unit"])

    units = durable(classes.select("id", "n", "embedding").mapInArrow(unit, "id long, n long, unit binary"), "units")
    members = clean.join(classes.select("embedding", F.col("id").alias("class")), "embedding").select("vec_id", "class")
    plain = units.select("id", "unit")
    lists, _ = descend(plain, units.count(), d, threshold, rounds)

    links = lists.where(F.col("s") >= threshold)
    named = durable(components(links.select("a", "b")), "known")
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    listed = both.join(units.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    full = links.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= MOST_LIST).select(F.col("a").alias("id"))
    crowded = named.join(full, "id", "left_semi").select("component").distinct()
    of_crowd = named.join(crowded, "component", "left_semi").join(units.select("id", "n"), "id")
    counted = _inside(of_crowd, plain, d, threshold).withColumnRenamed("links", "counted")
    groups = classes.select("id", "least", "n").join(named, "id", "left").join(listed, "id", "left").join(counted, "id", "left")
    more = F.coalesce("counted", "links", F.lit(0))
    groups = groups.select(F.col("id").alias("class"), "least", F.coalesce("component", "id").alias("component"), (more + F.col("n") - 1).alias("n_links"))
    groups = durable(groups, "groups")
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = members.join(groups.join(least, "component").select("class", "component_id", "n_links"), "class").select("vec_id", "n_links", "component_id")
    others = rows.where(~F.coalesce(F.expr(FINITE) & (F.size("embedding") == d), F.lit(False)))
    out = linked.union(others.select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))
