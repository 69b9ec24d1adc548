"""Documents of near-equal shingle sets by a grouped prefix join (operator 10)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.llm.common import components, durable, forget, mix64, prepare, relax, table

WIDTH = 3
#: Two sets link when PER_CENT * union <= 100 * intersection.
PER_CENT = 90
#: Shingles of all documents are counted in a table of 2 ** SKETCH_BITS counters, words in one of 2 ** WORD_BITS. The
#: order of shingles is by the counter of the shingle, then by those of its words: in a large input all but the very
#: frequent shingles share counters of one size, while words, which are far fewer, are still told apart. The order
#: makes fewer candidates and changes no result.
SKETCH_BITS, WORD_BITS, BLOCK_BITS = 22, 20, 16
#: A posting list is cut into this many parts for chaining, so a very long one is not one task's.
SALTS = 64
#: Lists with more parts of different components than LONG are compared in blocks of BLOCK, the others by pairs.
LONG, BLOCK = 64, 512


class Shingler:
    """Sets of hashed shingles: words without regard to the case of A-Z, parted by ASCII white space."""

    def __init__(self, width: int):
        self.width = width

    def codes(self, text: str | None) -> np.ndarray:
        """The hashed words of a text, in order."""
        words = (text or "").encode().lower().split()
        return mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))

    def shingles(self, codes: np.ndarray) -> np.ndarray:
        """The hashed shingle that starts at each place; of fewer words the whole, of none none."""
        n = len(codes)
        if not n:
            return codes
        k = min(self.width, n)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : n - k + 1 + i])
        return out

    def hashes(self, text: str | None) -> np.ndarray:
        """Distinct hashed shingles, sorted."""
        return np.unique(self.shingles(self.codes(text)))

    def ordered(self, text: str | None, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashed shingles, sorted; and once more in the one order of all sets, the rarest first."""
        codes = self.codes(text)
        h, first = np.unique(self.shingles(codes), return_index=True)
        if not len(h):
            return h, h
        word, k = levels.words[(codes >> np.uint64(64 - WORD_BITS)).astype(np.int64)].astype(np.int32), min(self.width, len(codes))
        total = np.concatenate([[0], np.cumsum(word)])
        of_words = np.minimum(total[first + k] - total[first], 255)
        level = levels.shingles[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int32)
        return h, h[np.argsort(level << 8 | of_words, kind="stable")]


@dataclass(frozen=True)
class Levels:
    """Of each counter the binary logarithm of its count, as one byte."""

    shingles: np.ndarray
    words: np.ndarray


_SHINGLERS: dict[int, Shingler] = {}


def shingler(width: int) -> Shingler:
    if width not in _SHINGLERS:
        _SHINGLERS[width] = Shingler(width)
    return _SHINGLERS[width]


def digest(sorted_hashes: np.ndarray, more: bytes = b"", salt: int = 0, size: int = 8) -> int:
    """A signed key of a set."""
    return int.from_bytes(hashlib.blake2b(sorted_hashes.tobytes() + more, digest_size=size, key=salt.to_bytes(4, "little") if salt else b"").digest(), "little", signed=True)


def prefix_size(n: int, per_cent: int) -> int:
    """Sets that link share a shingle among so many first ones."""
    return n - -(-per_cent * n // 100) + 1


def frequency_levels(docs: DataFrame, width: int) -> Levels:
    """Counters of all shingles and words, 2 ** SKETCH_BITS + 2 ** WORD_BITS bytes whatever the input."""
    sizes, per = (1 << SKETCH_BITS, 1 << WORD_BITS), 1 << BLOCK_BITS
    n = [size // per for size in sizes]

    def count(batches):
        own, totals = shingler(width), [np.zeros(size, np.uint32) for size in sizes]
        for b in batches:
            for text in b.column(0).to_pylist():
                codes = own.codes(text)
                for total, found, bits in ((totals[0], np.unique(own.shingles(codes)), SKETCH_BITS), (totals[1], codes, WORD_BITS)):
                    np.add.at(total, (found >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        total = np.concatenate(totals)
        for a in range(0, sum(n), 8):
            blocks = [zstandard.ZstdCompressor(level=1).compress(total[i * per : (i + 1) * per].tobytes()) for i in range(a, min(a + 8, sum(n)))]
            yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], names=["block", "counts"])
        del total, totals
        relax()

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(per, np.uint64)
        for x in rows.column("counts").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32)
        level = np.log2(total.astype(np.float64) + 1).astype(np.uint8)
        return pa.table([rows.column("block").slice(0, 1), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    parts = docs.select("text").mapInArrow(count, "block long, counts binary").groupBy("block").applyInArrow(add, "block long, levels binary")
    out = np.zeros(sum(sizes), np.uint8)
    for r in parts.collect():
        out[r.block * per : (r.block + 1) * per] = np.frombuffer(r.levels, np.uint8)
    return Levels(out[: sizes[0]], out[sizes[0] :])


def describe(docs: DataFrame, width: int, per_cent: int, levels: Levels, salt: int = 0) -> DataFrame:
    """Of each row: doc_id, n shingles, c (key of the set), c2 (another), g (key of prefix and size), and twice the prefix."""
    held = docs.sparkSession.sparkContext.broadcast(levels)  # of a fixed size

    def run(batches):
        own, late = shingler(width), held.value
        for b in batches:
            n, c, c2, g, p = [], [], [], [], []
            for text in b.column(1).to_pylist():
                h, head = own.ordered(text, late)
                size = prefix_size(len(h), per_cent) if len(h) else 0
                head = head[: 2 * size]
                n.append(len(h))
                c.append(digest(h, salt=salt))
                c2.append(digest(h, b"2", salt))
                g.append(digest(head[:size], len(h).to_bytes(8, "little"), salt))
                p.append(head.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, c, c2, g)), pa.array(p, pa.list_(pa.int64()))], names=["doc_id", "n", "c", "c2", "g", "head"])
            del n, c, c2, g, p, b
            relax()

    return docs.mapInArrow(run, "doc_id long, n long, c long, c2 long, g long, head array<long>")


def _classes(docs: DataFrame, width: int, per_cent: int, most: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """(rows, classes, salt): describe() of all rows, and one row for each distinct set.

    A set's key has 64 bits. Two sets of one key would differ in the other key: then all keys are made anew.
    """
    levels = frequency_levels(docs, width)
    for salt in range(most):
        rows = durable(describe(docs, width, per_cent, levels, salt), "rows")
        classes = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("g").alias("g"), F.first("head").alias("head"), F.min("c2").alias("lo"), F.max("c2").alias("hi"))
        classes = durable(classes, "classes")
        if classes.where("lo <> hi").isEmpty():
            return rows.drop("c2"), classes.where("rep is not null").drop("lo", "hi"), salt
        for old in (rows, classes):
            forget(old)
    raise RuntimeError("sets keep sharing keys")


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int, salt: int) -> DataFrame:
    """c and s, the packed sorted hashes of its set, of the wanted class keys; made again from the texts."""
    named = wanted.join(classes.select("c", "rep"), "c")

    def sets(batches):
        own = shingler(width)
        for b in batches:
            found = [own.hashes(t) for t in b.column(1).to_pylist()]
            keep = [digest(h, salt=salt) == c for h, c in zip(found, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), pa.array([h.tobytes() for h, k in zip(found, keep, strict=True) if k], pa.binary())], names=["c", "s"])

    full = docs.join(named, F.col("doc_id") == F.col("rep")).select("c", "text").mapInArrow(sets, "c long, s binary")
    return durable(full.dropDuplicates(["c"]), "sets")


def _long_lists(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, per_cent: int, salt: int) -> DataFrame:
    """Links between different components among the members (t, c, comp) of long posting lists.

    A list is cut into blocks of about BLOCK classes by their keys, and each pair of its blocks is compared in
    one task, in full, as a product of incidence matrices. Only links that join components leave the task, at
    most one for each class, so neither the pairs of a list nor its links are ever rows.
    """
    full = _sets(members.select("c").distinct(), classes, docs, width, salt)
    blocks = members.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = members.join(blocks, "t").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    cut = cut.select("t", "c", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("t", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "c", "comp").join(full, "c")

    def run(rows: pa.Table) -> pa.Table:
        c, comp, own = (rows.column(k).to_numpy() for k in ("c", "comp", "own"))
        one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("s").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        who = np.repeat(np.arange(len(sets)), sizes)
        _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(n > 1)
        place = np.full(len(n), -1)
        place[shared] = np.arange(len(shared))
        column = place[column]
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        both = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, len(shared), 4096):
            pick = (column >= start) & (column < start + 4096)
            matrix = np.zeros((len(sets), 4096), np.float32)
            matrix[who[pick], column[pick] - start] = 1
            both += matrix[left] @ matrix[right].T
        both = both.astype(np.int64)
        link = 100 * both >= per_cent * (sizes[left][:, None] + sizes[right][None] - both)
        link &= comp[left][:, None] != comp[right][None]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(link), strict=True):
            a, b = root(int(comp[left[i]])), root(int(comp[right[j]]))
            if a != b:
                parent[a] = b
                out.append((int(c[left[i]]), int(c[right[j]])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return durable(cut.groupBy("t", "one", "two").applyInArrow(run, "a long, b long"), "links")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, per_cent: int, salt: int) -> DataFrame:
    """Those of the pairs (a, b) of class keys whose sets link.

    First by the heads: sets that link share at least as many of twice the prefix as it is longer than the
    prefix. What is left is compared in full, with the sets made again from the texts.
    """
    heads = classes.select("c", "n", "head")
    one, two = (heads.select(F.col("c").alias(k), F.col("n").alias(f"n_{k}"), F.col("head").alias(f"h_{k}")) for k in "ab")

    def close(batches):
        for b in batches:
            n_a, n_b = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            h_a, h_b = (b.column(k).to_numpy(zero_copy_only=False) for k in ("h_a", "h_b"))
            keep = []
            for i in range(b.num_rows):
                spare = min(len(h_a[i]) - prefix_size(int(n_a[i]), per_cent), len(h_b[i]) - prefix_size(int(n_b[i]), per_cent)) + 1
                keep.append(len(np.intersect1d(h_a[i], h_b[i], assume_unique=True)) >= spare)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in (b.column("a"), b.column("b"))], names=["a", "b"])

    near = durable(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "h_a", "h_b").mapInArrow(close, "a long, b long"), "near")
    full = _sets(near.select(F.explode(F.array("a", "b")).alias("c")).distinct(), classes, docs, width, salt)

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    one, two = (full.select(F.col("c").alias(k), F.col("s").alias(f"s_{k}")) for k in "ab")
    links = durable(near.join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b").mapInArrow(exact, "a long, b long"), "links")
    forget(full)
    return links


def _chain(rows: DataFrame, key: str, node: str) -> DataFrame:
    """Neighbours in the order of (n, node) among the rows of a key, in salted parts and between the parts' first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)))
    inner = Window.partitionBy(key, "salt").orderBy("n", node)
    first = salted.groupBy(key, "salt").agg(F.min(F.struct("n", node)).alias("x")).select(key, "x.*")
    outer = Window.partitionBy(key).orderBy("n", node)
    steps = [f.withColumn("p", F.lag(F.struct("n", node)).over(w)).where("p is not null") for f, w in ((salted, inner), (first, outer))]
    return steps[0].select(F.col(f"p.{node}").alias("a"), F.col(node).alias("b"), F.col("p.n").alias("n_a"), F.col("n").alias("n_b")).union(
        steps[1].select(F.col(f"p.{node}").alias("a"), F.col(node).alias("b"), F.col("p.n").alias("n_a"), F.col("n").alias("n_b"))
    )


def link_documents(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    1. Rows of equal sets are one class; classes with the same prefix and size are one group.
    2. Groups that share a shingle of their prefixes and whose sizes allow it are candidates. In each posting
       list, and in each group, neighbours are verified first, which already connects most near copies.
    3. Of the group pairs, only those that hold classes of different components so far are expanded to
       members, all of them, and verified: pair by pair where a list is short, block by block where it is long.
       No pair that could join two components is left out.

    A row without words has n_shingles 0 and is its own component, a null doc_id stays null; rows that repeat a
    doc_id are linked by their own texts. An empty table gives an empty result; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    rows, classes, salt = _classes(docs, width, per_cent)
    sized = F.expr(f"100 * least(n_a, n_b) >= {per_cent} * greatest(n_a, n_b)")

    groups = classes.groupBy("g").agg(F.min(F.struct("c", "n", "head")).alias("x"), F.count(F.lit(1)).alias("members"))
    groups = groups.select("g", "members", F.col("x.c").alias("c"), F.col("x.n").alias("n"), F.col("x.head").alias("head"))
    size = F.expr(f"cast(n - ceil({per_cent} * n / 100.0d) + 1 as int)")
    postings = groups.select("g", "c", "n", F.posexplode(F.slice("head", F.lit(1), size)).alias("pos", "t"))
    shared = postings.groupBy("t").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("t")
    postings = durable(postings.join(shared, "t", "left_semi"), "postings")

    several = groups.where("members > 1").select("g")
    alike = classes.select("g", "c", "n").join(several, "g", "left_semi")
    first = _chain(alike, "g", "c").union(_chain(postings, "t", "c")).where(sized).where("a <> b")
    first = durable(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = _verify(first, classes, docs, width, per_cent, salt)
    known = durable(components(links), "known")

    # candidates between different components: of lists, then of groups
    of = classes.select("g", "c", "n").join(known.select(F.col("id").alias("c"), "component"), "c", "left").select("g", "c", "n", F.coalesce("component", "c").alias("comp"))
    of = durable(of.join(postings.select("g").union(several).distinct(), "g", "left_semi"), "of")
    parts = of.select("g", "comp").distinct()
    lists = postings.select("t", "g", "n", "pos").join(parts, "g")
    mixed = lists.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi")
    every = durable(lists.join(mixed.select("t", "k"), "t"), "lists")
    lists = every.where(F.col("k") <= long)
    left = lists.select("t", *(F.col(k).alias(f"{k}_a") for k in ("g", "n", "pos", "comp")))
    right = lists.select("t", *(F.col(k).alias(f"{k}_b") for k in ("g", "n", "pos", "comp")))
    reach = F.expr(f"least(n_a - pos_a, n_b - pos_b) >= ceil({per_cent} * (n_a + n_b) / {100 + per_cent}.0d)")
    across = left.join(right, "t").where("comp_a < comp_b").where(sized).where(reach).select("g_a", "comp_a", "g_b", "comp_b")
    inside = parts.join(several, "g", "left_semi")
    crowd = inside.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    inside = inside.join(crowd.where((F.col("k") > 1) & (F.col("k") <= long)), "g", "left_semi")
    inside = inside.select(F.col("g").alias("g_a"), F.col("comp").alias("comp_a")).join(inside.select(F.col("g").alias("g_b"), F.col("comp").alias("comp_b")), F.expr("g_a = g_b and comp_a < comp_b"))
    wide = across.union(inside.select("g_a", "comp_a", "g_b", "comp_b")).distinct()
    members = of.select("g", "comp", "c")
    pairs = wide.join(members.select(F.col("g").alias("g_a"), F.col("comp").alias("comp_a"), F.col("c").alias("a")), ["g_a", "comp_a"])
    pairs = pairs.join(members.select(F.col("g").alias("g_b"), F.col("comp").alias("comp_b"), F.col("c").alias("b")), ["g_b", "comp_b"])
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    pairs = durable(pairs, "pairs")
    more = _verify(pairs, classes, docs, width, per_cent, salt)
    members = members.select("g", "comp", "c")
    wide_lists = every.where(F.col("k") > long).select("t", "g", "comp").join(members, ["g", "comp"]).select("t", "c", "comp").distinct()
    wide_groups = members.join(crowd.where(F.col("k") > long), "g", "left_semi").select(F.col("g").alias("t"), "c", "comp")
    more = more.union(_long_lists(wide_lists.union(wide_groups), classes, docs, width, per_cent, salt))
    final = known
    if not more.isEmpty():
        final = durable(components(more.union(known.select(F.col("id").alias("a"), F.col("component").alias("b")))), "known")

    named = classes.select("c", "rep").join(final.select(F.col("id").alias("c"), "component"), "c", "left").select("c", "rep", F.coalesce("component", "c").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "component").select("c", "component_id")
    out = rows.where("n > 0").select("doc_id", "n", "c").join(by_class, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op10_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))
